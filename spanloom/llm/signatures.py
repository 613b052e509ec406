"""Hand-written license signatures: a label, a priority, a keyword that must occur, and a pattern over lower-cased text with single blanks."""

from __future__ import annotations

from typing import NamedTuple

#: Priorities: an explicit identifier, a full notice, a name with a version, a bare name, a hint.
IDENTIFIER, NOTICE, VERSIONED, NAME, HINT = 50, 40, 30, 20, 10


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Hand-written single rules.
SINGLE = (
    Rule("mit", NOTICE, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    Rule("mit", NOTICE, "mit license", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license"),
    Rule("mit", NAME, "mit license", r"\b(?:the )?mit license\b"),
    Rule("mit", NAME, "mit/x11", r"\bmit/x11(?: license)?\b"),
    Rule("mit", NAME, "expat", r"\bexpat license\b"),
    Rule("mit-0", VERSIONED, "mit no attribution", r"\bmit no attribution\b"),
    Rule("x11", NAME, "x11 license", r"\bx11 license\b"),
    Rule("isc", NAME, "isc license", r"\bisc license\b"),
    Rule("isc", NOTICE, "permission to use, copy", r"permission to use, copy, modify, and/?o?r? distribute this software for any purpose"),
    Rule("bsd", NAME, "bsd license", r"\bbsd(?:[- ]style)? license\b"),
    Rule("bsd-2-clause", VERSIONED, "bsd", r"\b(?:bsd[- ]2[- ]clause|(?:simplified|2-clause|two-clause|freebsd) bsd)(?: license)?\b"),
    Rule("bsd-3-clause", VERSIONED, "bsd", r"\b(?:bsd[- ]3[- ]clause|(?:new|modified|revised|3-clause|three-clause) bsd)(?: license)?\b"),
    Rule("bsd-4-clause", VERSIONED, "bsd", r"\b(?:bsd[- ]4[- ]clause|(?:original|4-clause|four-clause) bsd)(?: license)?\b"),
    Rule("bsd-0-clause", VERSIONED, "bsd", r"\b(?:0bsd|zero[- ]clause bsd)(?: license)?\b"),
    Rule("bsd", NOTICE, "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    Rule("apache", NAME, "apache license", r"\b(?:the )?apache (?:software )?license\b"),
    Rule("apache-2.0", NOTICE, "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0"),
    Rule("apache-2.0", VERSIONED, "asl 2.0", r"\basl 2\.0\b"),
    Rule("gpl", NAME, "general public license", r"\b(?:the )?(?:gnu )?general public license\b"),
    Rule("gpl", NOTICE, "free software foundation", r"terms of the gnu general public license as published by the free software foundation"),
    Rule("gpl", HINT, "gpl", r"\bgpl\b"),
    Rule("lgpl", NAME, "lesser general public", r"\b(?:the )?(?:gnu )?lesser general public license\b"),
    Rule("lgpl", NAME, "library general public", r"\b(?:the )?(?:gnu )?library general public license\b"),
    Rule("lgpl", HINT, "lgpl", r"\blgpl\b"),
    Rule("agpl", NAME, "affero general public", r"\b(?:the )?(?:gnu )?affero general public license\b"),
    Rule("agpl", HINT, "agpl", r"\bagpl\b"),
    Rule("gfdl", NAME, "free documentation license", r"\b(?:gnu )?free documentation license\b"),
    Rule("mpl", NAME, "mozilla public license", r"\bmozilla public license\b"),
    Rule("epl", NAME, "eclipse public license", r"\beclipse public license\b"),
    Rule("cddl", NAME, "common development and distribution", r"\bcommon development and distribution license\b"),
    Rule("cpl", NAME, "common public license", r"\bcommon public license\b"),
    Rule("eupl", NAME, "european union public", r"\beuropean union public licen[cs]e\b"),
    Rule("artistic", NAME, "artistic license", r"\b(?:the )?artistic license\b"),
    Rule("bsl-1.0", VERSIONED, "boost software license", r"\bboost software license\b"),
    Rule("busl-1.1", VERSIONED, "business source license", r"\bbusiness source license\b"),
    Rule("sspl-1.0", VERSIONED, "server side public license", r"\bserver side public license\b"),
    Rule("elastic-2.0", VERSIONED, "elastic license", r"\belastic license(?: 2\.0)?\b"),
    Rule("zlib", NAME, "zlib license", r"\b(?:the )?zlib(?:/libpng)? license\b"),
    Rule("libpng", NAME, "libpng license", r"\blibpng license\b"),
    Rule("unlicense", NAME, "unlicense", r"\b(?:the )?unlicense\b"),
    Rule("unlicense", NOTICE, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    Rule("wtfpl", NAME, "wtfpl", r"\bwtfpl\b"),
    Rule("wtfpl", NAME, "do what the fuck", r"do what the fuck you want to public license"),
    Rule("public-domain", NAME, "public domain", r"\b(?:released|dedicated|placed) (?:in|into|to) the public domain\b"),
    Rule("public-domain", HINT, "public domain", r"\bpublic domain\b"),
    Rule("python-2.0", NAME, "python software foundation", r"\bpython software foundation license\b"),
    Rule("ruby", NAME, "ruby license", r"\bruby license\b"),
    Rule("php-3.01", NAME, "php license", r"\bphp license\b"),
    Rule("openssl", NAME, "openssl license", r"\bopenssl license\b"),
    Rule("postgresql", NAME, "postgresql license", r"\bpostgresql licen[cs]e\b"),
    Rule("ncsa", NAME, "ncsa open source", r"\b(?:university of illinois/)?ncsa open source license\b"),
    Rule("ofl-1.1", NAME, "open font license", r"\bsil open font license\b"),
    Rule("odbl-1.0", NAME, "open database license", r"\bopen database license\b"),
    Rule("cc0-1.0", VERSIONED, "cc0", r"\bcc0(?:[- ]1\.0)?\b"),
    Rule("cc", HINT, "creative commons", r"\bcreative commons\b"),
    Rule("proprietary", NOTICE, "all rights reserved", r"\ball rights reserved\b"),
    Rule("proprietary", NOTICE, "proprietary and confidential", r"\bproprietary and confidential\b"),
    Rule("copyright", HINT, "copyright", r"\bcopyright (?:\(c\)|©) ?\d{4}\b"),
    # full notices
    Rule("mit", NOTICE, "substantial portions", r"this permission notice shall be included in all copies or substantial portions of the software"),
    Rule("bsd-3-clause", NOTICE, "neither the name", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    Rule("bsd-4-clause", NOTICE, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    Rule("bsd", NOTICE, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    Rule("apache-2.0", NOTICE, "apache license", r"licensed under the apache license, version 2\.0 \(the [\"“]?license[\"”]?\); you may not use this file except in compliance"),
    Rule("apache-1.1", NOTICE, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    Rule("gpl", NOTICE, "this program is free software", r"this program is free software[;:,] you can redistribute it and/or modify"),
    Rule("gpl", NOTICE, "gnu general public license", r"you should have received a copy of the gnu general public license"),
    Rule("lgpl", NOTICE, "gnu lesser general public", r"you should have received a copy of the gnu lesser general public license"),
    Rule("lgpl", NOTICE, "gnu library general public", r"you should have received a copy of the gnu library general public license"),
    Rule("agpl", NOTICE, "gnu affero general public", r"you should have received a copy of the gnu affero general public license"),
    Rule("mpl-2.0", NOTICE, "mozilla public license", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    Rule("mpl-1.1", NOTICE, "mozilla public license", r"contents of this file are subject to the mozilla public license,? version 1\.1"),
    Rule("cddl", NOTICE, "common development and distribution", r"contents of this file are subject to the terms of the common development and distribution license"),
    Rule("epl-1.0", NOTICE, "eclipse public license", r"made available under the terms of the eclipse public license v ?1\.0"),
    Rule("epl-2.0", NOTICE, "eclipse public license", r"made available under the terms of the eclipse public license v?\.? ?2\.0"),
    Rule("bsl-1.0", NOTICE, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    Rule("zlib", NOTICE, "altered source versions", r"altered source versions must be plainly marked as such"),
    Rule("hpnd", NOTICE, "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    Rule("postgresql", NOTICE, "written agreement", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    Rule("ntp", NOTICE, "with or without fee", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose with or without fee"),
    Rule("openssl", NOTICE, "openssl project", r"this product includes software developed by the openssl project"),
    Rule("ssleay", NOTICE, "eric young", r"this product includes cryptographic software written by eric young"),
    Rule("json", NOTICE, "for good, not evil", r"the software shall be used for good, not evil"),
    Rule("beerware", NOTICE, "buy me a beer", r"you think this stuff is worth it, you can buy me a beer"),
    Rule("wtfpl", NOTICE, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    Rule("gpl", NOTICE, "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    Rule("unlicense", NOTICE, "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software"),
    Rule("cc0-1.0", NOTICE, "waived all copyright", r"to the extent possible under law, .{1,120}? waived all copyright"),
    Rule("cc0-1.0", IDENTIFIER, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    Rule("public-domain", IDENTIFIER, "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0"),
    Rule("artistic", NOTICE, "the intent of this document", r"the intent of this document is to state the conditions under which a package may be copied"),
    Rule("perl", NOTICE, "same terms as perl", r"under the same terms as perl itself"),
    Rule("ruby", NOTICE, "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    Rule("php-3.01", NOTICE, "php software", r"this product includes php software"),
    Rule("ofl-1.1", NOTICE, "open font license", r"this font software is licensed under the sil open font license, version 1\.1"),
    Rule("fsfap", NOTICE, "in any medium without royalty", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty"),
    Rule("ijg", NOTICE, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    Rule("ftl", NOTICE, "freetype", r"portions of this software are copyright .{1,80}? the freetype project"),
    # exceptions beside a license
    Rule("classpath-exception-2.0", VERSIONED, "classpath", r"\bclasspath[- ]exception(?:[- ]2\.0)?"),
    Rule("gcc-exception-3.1", VERSIONED, "runtime library exception", r"\bgcc runtime library exception\b"),
    Rule("autoconf-exception", VERSIONED, "autoconf", r"\bautoconf (?:configure script )?exception\b"),
    Rule("bison-exception", VERSIONED, "bison", r"\bbison exception\b"),
    Rule("font-exception-2.0", VERSIONED, "font exception", r"\bgpl font exception\b"),
    Rule("llvm-exception", VERSIONED, "llvm", r"\bllvm[- ]exceptions?\b"),
    Rule("linking-exception", VERSIONED, "linking exception", r"\b(?:gpl |lgpl )?(?:static )?linking exception\b"),
    # approved licenses by name
    Rule("afl", NAME, "academic free license", r"\bacademic free license\b"),
    Rule("osl", NAME, "open software license", r"\bopen software license\b"),
    Rule("rpl", NAME, "reciprocal public license", r"\breciprocal public license\b"),
    Rule("cpal-1.0", NAME, "common public attribution", r"\bcommon public attribution license\b"),
    Rule("ecl", NAME, "educational community license", r"\beducational community license\b"),
    Rule("fair", NAME, "fair license", r"\bfair license\b"),
    Rule("frameworx-1.0", NAME, "frameworx", r"\bframeworx (?:open )?license\b"),
    Rule("lpl", NAME, "lucent public license", r"\blucent public license\b"),
    Rule("miros", NAME, "miros licen", r"\bmiros licen[cs]e\b"),
    Rule("motosoto", NAME, "motosoto", r"\bmotosoto (?:open source )?license\b"),
    Rule("multics", NAME, "multics license", r"\bmultics license\b"),
    Rule("nasa-1.3", NAME, "nasa open source", r"\bnasa open source agreement\b"),
    Rule("naumen", NAME, "naumen public license", r"\bnaumen public license\b"),
    Rule("ngpl", NAME, "nethack general public", r"\bnethack general public license\b"),
    Rule("oclc-2.0", NAME, "oclc research public", r"\boclc research public license\b"),
    Rule("ogtsl", NAME, "open group test suite", r"\bopen group test suite license\b"),
    Rule("rscpl", NAME, "ricoh source code public", r"\bricoh source code public license\b"),
    Rule("simpl-2.0", NAME, "simple public license", r"\bsimple public license\b"),
    Rule("sissl", NAME, "sun industry standards", r"\bsun industry standards source license\b"),
    Rule("spl-1.0", NAME, "sun public license", r"\bsun public license\b"),
    Rule("watcom-1.0", NAME, "open watcom public", r"\bsybase open watcom public license\b"),
    Rule("upl-1.0", NAME, "universal permissive license", r"\buniversal permissive license\b"),
    Rule("vsl-1.0", NAME, "vovida software license", r"\bvovida software license\b"),
    Rule("wxwindows", NAME, "wxwindows library", r"\bwxwindows library licen[cs]e\b"),
    Rule("xnet", NAME, "x.net license", r"\bx\.net(?:,? inc\.?)? license\b"),
    Rule("zpl", NAME, "zope public license", r"\bzope public license\b"),
    Rule("apsl", NAME, "apple public source", r"\bapple public source license\b"),
    Rule("ms-pl", NAME, "microsoft public license", r"\bmicrosoft public license\b"),
    Rule("ms-rl", NAME, "microsoft reciprocal license", r"\bmicrosoft reciprocal license\b"),
    Rule("ipl-1.0", NAME, "ibm public license", r"\bibm public license\b"),
    Rule("intel", NAME, "intel open source license", r"\bintel open source license\b"),
    Rule("nokia", NAME, "nokia open source license", r"\bnokia open source license\b"),
    Rule("qpl-1.0", NAME, "q public license", r"\bq public license\b"),
    Rule("sleepycat", NAME, "sleepycat", r"\bsleepycat (?:public )?license\b"),
    Rule("lppl", NAME, "latex project public", r"\blatex project public license\b"),
    Rule("cecill", NAME, "cecill", r"\bcecill(?:-[bc])?(?: free software)? licen[cs]e"),
    Rule("mulan-psl", NAME, "mulan", r"\bmulan (?:psl|permissive software license)\b"),
    Rule("blueoak-1.0.0", NAME, "blue oak model license", r"\bblue oak model license\b"),
    Rule("entessa", NAME, "entessa public license", r"\bentessa public license\b"),
    Rule("aal", NAME, "attribution assurance license", r"\battribution assurance license\b"),
    Rule("apl-1.0", NAME, "adaptive public license", r"\badaptive public license\b"),
    Rule("catosl-1.1", NAME, "trusted open source license", r"\bcomputer associates trusted open source license\b"),
    Rule("cua-opl-1.0", NAME, "cua office public", r"\bcua office public license\b"),
    Rule("efl", NAME, "eiffel forum license", r"\beiffel forum license\b"),
    Rule("eudatagrid", NAME, "datagrid", r"\beu datagrid software license\b"),
    Rule("openldap", NAME, "openldap public license", r"\bopenldap public license\b"),
    Rule("erlang", NAME, "erlang public license", r"\berlang public license\b"),
    Rule("npl", NAME, "netscape public license", r"\bnetscape public license\b"),
    Rule("sgi-b-2.0", NAME, "sgi free software license", r"\bsgi free software license b\b"),
    Rule("smlnj", NAME, "standard ml of new jersey", r"\bstandard ml of new jersey license\b"),
    Rule("xfree86", NAME, "xfree86", r"\bxfree86(?: project)? license\b"),
    Rule("zend-2.0", NAME, "zend", r"\bzend (?:engine )?license\b"),
    Rule("tcl", NAME, "tcl/tk license", r"\btcl/tk license\b"),
    Rule("vim", NAME, "vim license", r"\bvim license\b"),
    Rule("curl", NAME, "curl license", r"\bcurl license\b"),
    Rule("icu", NAME, "icu license", r"\bicu license\b"),
    Rule("unicode", NAME, "unicode license", r"\bunicode license(?: agreement)?\b"),
    Rule("w3c", NAME, "w3c", r"\bw3c software (?:and document )?(?:notice and )?license\b"),
    Rule("json", NAME, "json license", r"\bjson license\b"),
    Rule("beerware", NAME, "beer", r"\bbeer-?ware(?: license)?\b"),
    Rule("imagemagick", NAME, "imagemagick license", r"\bimagemagick license\b"),
    Rule("info-zip", NAME, "info-zip license", r"\binfo-zip license\b"),
    Rule("libtiff", NAME, "libtiff license", r"\blibtiff license\b"),
    Rule("ftl", NAME, "freetype", r"\bfreetype (?:project )?license\b"),
    Rule("bittorrent", NAME, "bittorrent open source license", r"\bbittorrent open source license\b"),
    Rule("jabber", NAME, "jabber open source license", r"\bjabber open source license\b"),
    Rule("zimbra", NAME, "zimbra public license", r"\bzimbra public license\b"),
    Rule("ypl", NAME, "yahoo! public license", r"\byahoo! public license\b"),
    Rule("tmate", NAME, "tmate open source license", r"\btmate open source license\b"),
    Rule("bitstream-vera", NAME, "bitstream vera", r"\bbitstream vera fonts? copyright\b"),
    Rule("cnri-python", NAME, "cnri", r"\bcnri (?:open source )?license agreement\b"),
    # works, data and hardware
    Rule("odc-by-1.0", NAME, "open data commons", r"\bopen data commons attribution license\b"),
    Rule("pddl-1.0", NAME, "public domain dedication", r"\b(?:open data commons )?public domain dedication and license\b"),
    Rule("cdla-permissive", NAME, "community data license", r"\bcommunity data license agreement(?: [-–])? permissive\b"),
    Rule("cdla-sharing", NAME, "community data license", r"\bcommunity data license agreement(?: [-–])? sharing\b"),
    Rule("ogl-uk", NAME, "open government licen", r"\bopen government licen[cs]e\b"),
    Rule("etalab", NAME, "licence ouverte", r"\blicence ouverte\b"),
    Rule("dl-de", NAME, "datenlizenz", r"\bdatenlizenz deutschland\b"),
    Rule("free-art", NAME, "free art license", r"\bfree art license\b"),
    Rule("free-art", NAME, "licence art libre", r"\blicence art libre\b"),
    Rule("opubl-1.0", NAME, "open publication license", r"\bopen publication license\b"),
    Rule("dsl", NAME, "design science license", r"\bdesign science license\b"),
    Rule("cern-ohl", NAME, "cern open hardware", r"\bcern open hardware licen[cs]e\b"),
    Rule("tapr-ohl", NAME, "tapr open hardware", r"\btapr open hardware license\b"),
    Rule("shl", NAME, "solderpad hardware license", r"\bsolderpad hardware license\b"),
    # source available and restricted
    Rule("commons-clause", NAME, "commons clause", r"[\"“]?commons clause[\"”]? license condition"),
    Rule("confluent", NAME, "confluent community license", r"\bconfluent community license\b"),
    Rule("rsal", NAME, "redis source available", r"\bredis source available license\b"),
    Rule("timescale", NAME, "timescale license", r"\btimescale license\b"),
    Rule("cockroach", NAME, "cockroachdb community license", r"\bcockroachdb community license\b"),
    Rule("fsl-1.1", NAME, "functional source license", r"\bfunctional source license\b"),
    Rule("polyform-noncommercial", NAME, "polyform", r"\bpolyform noncommercial license\b"),
    Rule("polyform-small-business", NAME, "polyform", r"\bpolyform small business license\b"),
    Rule("polyform-shield", NAME, "polyform", r"\bpolyform shield license\b"),
    Rule("parity", NAME, "parity public license", r"\bparity public license\b"),
    Rule("prosperity", NAME, "prosperity public license", r"\bprosperity public license\b"),
    Rule("hippocratic", NAME, "hippocratic license", r"\bhippocratic license\b"),
    Rule("anti-996", NAME, "anti-996 license", r"\banti-996 license\b"),
    Rule("ppl", NAME, "peer production license", r"\bpeer production license\b"),
    Rule("aladdin", NAME, "aladdin free public", r"\baladdin free public license\b"),
    Rule("openrail", NAME, "openrail", r"\bopenrail(?:\+\+)?(?:-[ms])? license\b"),
    Rule("openrail", NAME, "open rail", r"\bcreativeml open rail(?:\+\+)?-m\b"),
    Rule("rail", NAME, "responsible ai license", r"\bresponsible ai licenses?\b"),
    Rule("oracle-bcl", NAME, "oracle binary code license", r"\boracle binary code license(?: agreement)?\b"),
    Rule("oracle-otn", NAME, "oracle technology network", r"\boracle technology network license(?: agreement)?\b"),
    Rule("nvidia", NAME, "nvidia software license", r"\bnvidia software license agreement\b"),
    Rule("eula", NAME, "end user license", r"\bend[- ]user license agreement\b"),
    Rule("eula", NAME, "end-user license", r"\bend-user license agreement\b"),
    Rule("proprietary", NOTICE, "unauthorized copying", r"unauthorized copying of this file,? via any medium,? is strictly prohibited"),
    Rule("proprietary", NOTICE, "may be reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    Rule("shareware", HINT, "shareware", r"\bshareware\b"),
    Rule("freeware", HINT, "freeware", r"\bfreeware\b"),
)
