"""Owners and repositories decide together whether a secret is a copied example."""

from __future__ import annotations

from tessera.llm import secrets


def test_two_owners_in_many_repositories_copy(spark):
    few, many, alone, joint = "Zq7" * 10, "Xw5" * 10, "Vn9" * 10, "Kd4" * 10
    rows = [(i, few, f"o{i % 2}") for i in range(8)] + [(20 + i, many, f"o{i % 2}") for i in range(9)] + [(40 + i, alone, "o0") for i in range(20)]
    rows += [(70 + i, joint, None if i else "o0") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.secret_scan(docs).collect()}
    assert got[0] == got[40] == (1, 0)
    assert got[20] == got[70] == (0, 1)
