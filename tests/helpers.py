from spanloom.schema import EVENT


def events(spark, rows):
    """Events from partial dicts; arrival is the order given."""
    full = []
    for n, r in enumerate(rows):
        base = {f.name: None for f in EVENT.fields} | {"ts": 0, "seq": 1, "event_type": 3, "_arrival": n} | r
        base["ext_span_id"] = base["ext_span_id"] or f"{base['trace_id']}-{base['span_id']}"
        full.append(tuple(base[f.name] for f in EVENT.fields))
    return spark.createDataFrame(full, EVENT)


def one(df):
    (row,) = df.collect()
    return row
