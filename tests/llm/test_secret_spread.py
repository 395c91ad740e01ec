"""How far secrets have spread: by owners, which decide, and by repositories."""

from graphloom.llm import secrets


def test_owners_decide_and_repositories_are_told(spark):
    own, shared = "AKIA" + "Q7" * 9, "AKIA" + "EXAMPLE" * 3
    rows = [(i, f"key {own}", "one", lang) for i, lang in enumerate(("en", "fr", "de", "fr"))]
    rows += [(10 + i, f"key {shared}", owner, "en") for i, owner in enumerate(("one", "two", "three"))]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    told = {r["doc_id"]: [(s["owners"], s["repositories"], s["copied"]) for s in r["spans"]] for r in found.collect()}
    assert all(told[i] == [(1, 3, False)] for i in range(4)) and all(told[10 + i] == [(3, 3, True)] for i in range(3))
