"""Full licence texts, titled ones, and lines of a holder against lines of prose."""

import textwrap
from pathlib import Path

from quillgraph.llm import licenses


def test_full_titled_and_wrapped_texts(spark):
    full = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(full)
    cases = list(full.items()) + list(licenses.SHORT.items())
    cases.append(("Apache-2.0", full["Apache-2.0"].split("END OF TERMS")[0]))
    cases += [(k, f"{t[0]}\n\nCopyright (c) 2020, Somebody\n\n{licenses.KNOWN[k]}") for k, t in licenses.KNOWN_TITLES.items()]
    for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"):
        for holder in ("Copyright 2020 A. Author", "Copyright Somebody", "(c) Some Body", "Copyright, 2019 by X", "# Copyright the Authors"):
            cases.append((k, holder + "\n\n" + licenses.KNOWN[k]))
        cases += [(k, textwrap.fill(licenses.KNOWN[k], width)) for width in range(24, 84)]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(d, licenses.known_licenses(spark), len(licenses.all_known())).collect()}
    assert [(k, got[i]) for i, (k, _) in enumerate(cases) if got[i] != k] == []
