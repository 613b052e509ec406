"""A plain-Python fold, the oracle of the property tests."""

from spanloom.schema import SCALARS


def fold(events):
    seen, groups = set(), {}
    for e in sorted(events, key=lambda e: e["_arrival"]):
        ident = (e["ext_span_id"], e["seq"], e["event_type"])
        if ident in seen:
            continue
        seen.add(ident)
        groups.setdefault((e["trace_id"], e["span_id"]), []).append(e)
    out = {}
    for key, rows in groups.items():
        rows.sort(key=lambda e: (e["seq"], e["_arrival"]))
        span = dict.fromkeys(SCALARS)
        logs, attrs = [], {}
        for e in rows:
            for c in SCALARS:
                if e.get(c) is not None:
                    span[c] = e[c]
            for x in e.get("logs") or []:
                if x not in logs:
                    logs.append(x)
            attrs.update(e.get("attrs") or {})
        out[key] = span | {
            "logs": logs,
            "attrs": attrs,
            "event_count": len(rows),
            "has_start": any(e["event_type"] == 1 for e in rows),
            "has_end": any(e["event_type"] == 2 for e in rows),
        }
    return out
