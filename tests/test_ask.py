"""Search and questions from body to response, against plain Python; models that fail; amendments that override."""

import json
import math
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioforge.operators import ask

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't import tests
KINDS = "id string, corpus string, ord int, source_path string, start_line int, end_line int, content string, embedding array<double>, meta map<string,string>"
REGISTRY = [(0, "base", "Base", False, None), (1, "am", "Amendments", True, "base"), (2, "other", "Other", None, None)]
LETTERS = "abcdr"


def embed(texts):
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


CHUNKS = [
    ("b-0", "base", 0, "p/0.txt", 1, 3, "aaa first rule R301 text", {"sectionId": "R301", "sectionLabel": "Section R301", "publicUrl": "u"}),
    ("b-1", "base", 1, "p/1.txt", 4, 9, "aab second rule text", {"sectionId": "302"}),
    ("b-2", "base", 2, "p/2.txt", 1, 2, "bbb third rule", {}),
    ("a-0", "am", 0, "q/R302_x.txt", 1, 2, "aa In IRC, Section R302 is deleted.", {"section": "R302"}),
    ("o-0", "other", 0, "o.txt", 1, 1, "ab", {}),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(*c[:6], c[6], embed([c[6]])[0], c[7]) for c in CHUNKS], KINDS)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REGISTRY, "ord int, id string, label string, is_amendment boolean, base_id string")


def bodies(spark, *found):
    return spark.createDataFrame([(k, b if isinstance(b, str) or b is None else json.dumps(b)) for k, b in enumerate(found)], "request_id int, body string")


def best(query, corpus, k):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)) if any(a) and any(b) else 0.0
    own = [c for c in CHUNKS if c[1] == corpus]
    return sorted(own, key=lambda c: (-cos(embed([query])[0], embed([c[6]])[0]), c[2]))[:k]


def test_search(spark, chunks):
    asked = [{"query": " aaa ", "topK": 2}, {"query": "b", "codebookId": "other"}, {"query": "  "}, "no json", {"query": "b", "topK": 0}, {"query": "x", "codebookId": "none"}, {"query": "b", "topK": -1}, None]
    got = {r.request_id: (r.status, json.loads(r.response)) for r in ask.search(bodies(spark, *asked), chunks, embed).collect()}
    assert got[0] == (200, {"ok": True, "query": "aaa", "codebookId": "base", "topK": 2, "results": [{"id": c[0], "sourcePath": c[3], "startLine": c[4], "endLine": c[5], "contentPreview": c[6]} for c in best("aaa", "base", 2)]})
    assert [r["id"] for r in got[1][1]["results"]] == ["o-0"] and got[1][1]["topK"] == 5
    assert [r["id"] for r in got[4][1]["results"]] == [c[0] for c in best("b", "base", 5)]
    assert got[5][1]["results"] == []
    assert [got[k][0] for k in (2, 3, 6, 7)] == [400] * 4 and got[3][1] == {"error": "Invalid JSON body"}


def select(prompts):
    found = []
    for p in prompts:
        if "refuse" in p:
            found.append('{"cannotAnswer": true}')
        elif "broken" in p:
            raise RuntimeError("model")
        else:
            n, text = re.search(r"\[source (\d+), lines \d+-\d+\] Section R301\n(.*)", p).groups()
            found.append(json.dumps({"sections": [{"title": "Rule", "items": [{"sourceId": int(n), "excerpt": text[:14]}]}]}))
    return found


def reply(prompts):
    if any("silent" in p for p in prompts):
        raise RuntimeError("model")
    return ["It says " + '"' + re.search(r"lines \d+-\d+\]\n(.*)", p)[1] + '" [source 1, lines 1-3].' for p in prompts]


def test_ask(spark, chunks, registry):
    asked = [{"query": "aaa"}, {"query": "aaa refuse"}, {"query": "aaa broken"}, {"query": "aaa silent"}, {"query": ""}, "{", {"query": "aaa", "codebookId": "am"}, {"query": "aaa", "includeAmendments": False}, {"query": "aaa", "topK": 0}]
    got = {r.request_id: (r.status, json.loads(r.response)) for r in ask.ask(bodies(spark, *asked), chunks, registry, embed, select, reply).collect()}
    fine = got[0][1]
    # the amendment deletes R302: of the base the rows of R302 and without an id go
    assert [s["id"] for s in fine["sources"]] == ["a-0", "b-0"] and [s["sourceId"] for s in fine["sources"]] == [1, 2]
    assert fine["ok"] and fine["answer"] == 'It says "aaa first rule" [source 1, lines 1-3].' and fine["reason"] is None
    assert [(a["id"], a["sectionLabel"], a["citation"], a["fullText"]) for a in fine["amendments"]] == [("a-0", "R302", "[source 1, lines 1-2]", CHUNKS[3][6])]
    for k in (1, 2, 3):  # a refusal, a selector that fails, an answer model that fails: its stand-in is no valid answer
        assert got[k][0] == 200 and not got[k][1]["ok"] and got[k][1]["answer"] is None and got[k][1]["reason"].startswith("I cannot answer")
        assert [s["id"] for s in got[k][1]["sources"]] == ["a-0", "b-0"]
    assert (got[4][0], got[4][1]["reason"]) == (400, "Missing or empty 'query' field.") and got[5][1]["reason"] == "Invalid JSON body"
    assert (got[6][0], got[6][1]["reason"]) == (400, "Invalid base codebookId: am")
    assert [s["id"] for s in got[7][1]["sources"]] == [c[0] for c in best("aaa", "base", 6)] and got[7][1]["amendments"] == []
    assert got[8][1]["sources"] == [] and not got[8][1]["ok"]


def test_memory(spark, chunks, registry):
    """A follow-up is anchored by the last hint; a question that names a code isn't; only answered ones are remembered."""
    history = spark.createDataFrame([("s", 1, "user", "bbb", None), ("s", 2, "assistant", None, "Section R301")], "session string, ord int, role string, query string, hint string")
    asked = [{"query": "and then", "sessionId": " s "}, {"query": "R302", "sessionId": "s"}, {"query": "aaa refuse", "sessionId": "s"}, {"query": "aaa"}]
    anchored = session_queries(spark, asked, history)
    assert anchored == {0: "Section R301\n\nFollow-up question:\nand then", 1: "R302", 2: "Section R301\n\nFollow-up question:\naaa refuse", 3: "aaa"}
    done = ask.ask(bodies(spark, *asked[2:], {"query": "aaa", "sessionId": "t"}), chunks, registry, embed, select, reply, history)
    assert [tuple(r) for r in ask.remembered(done).orderBy("role").collect()] == [(2, "t", "assistant", None, "q/R302_x.txt"), (2, "t", "user", "aaa", None)]


def session_queries(spark, asked, history):
    from folioforge.operators import session

    rows = ask.anchored(ask.requests(bodies(spark, *asked), "base", 6), history)
    return {r.request_id: r.effective_query for r in session.effective_query(rows, "query").collect()}


def test_providers(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    assert [r.v for r in ask.replied(df, "t", lambda ps: [p.upper() for p in ps], "v").collect()] == ["A", None, "B"]
    with pytest.raises(Exception, match="left out"):
        ask.embedded(df, "t", lambda ts: [[1.0]] * (len(ts) - 1) + [[]]).select(F.sum(F.get("embedding", 0))).collect()
