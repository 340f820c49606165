import hashlib
import re

from rillwork.llm import secrets
from tests.llm.odd import no_docs, odd_docs

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
        ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
LEAST = {"assign": 8, "access": 16, "hex": 32}


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE):
        out += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


TEXTS = [
    'token = "0641917ea4e9feb9cda83477b57ac2654884f485" and', "PassWord:abc", "api_key='Abcdefgh1'APIKEY=12345678", "AKIAAKIAAKIAAKIAX AKIA12345678901 AKIA123456789012",
    "x" + "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g", "é" * 5 + " secret=abcdefgh.=- tail", "pa\u017fsword=abcdefgh", "token==abcdefgh", "a" * 31, "passwd  :  \"abcdefgh\"", "",
]


def test_base_spans_are_those_of_the_patterns():
    for text in TEXTS:
        assert [(k, a, b) for k, a, b, _ in secrets.base_spans(text)] == plain_spans(text)


def test_owners_tell_examples_from_live_values(spark):
    example, live, random = "password=0123456789abcd", "password=9876543210zyxw", "Zk3v9Qp7Lm2Xc8Rt5Yb1Wd6"
    rows = [(i, f"see {example} here", f"s{i}") for i in range(5)] + [(9, f"mine {live} and {random}", "s0"), (10, f"{live}", "s1"), (11, None, "s2"), (12, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.weigh_secrets(docs, keep=("doc_id",)).collect()}
    assert [(got[i].n_live, got[i].n_copied) for i in (0, 9, 10, 11, 12)] == [(0, 1), (2, 0), (1, 0), (0, 0), (0, 0)]
    assert [s["kind"] for s in got[9].found] == ["assign", "random"]
    masked = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert masked[0] == f"see {example} here" and masked[9] == "mine password=[SECRET] and [SECRET]" and masked[11] is None


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = secrets.weigh_secrets(docs, keep=("doc_id", "node", "score")).collect()
    assert len(got) == docs.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert sorted(map(str, secrets.mask_live(docs).collect())) == sorted(map(str, docs.collect()))
    assert secrets.weigh_secrets(no_docs(spark), keep=("doc_id",)).count() == 0


def test_long_runs_are_spans(spark):
    long = "Zk3v9Qp7Lm2Xc8Rt5Yb1Wd6/" * 40
    rows = [(1, f"key {long} end", "s0"), (2, f"jwt eyJhbGci.{long[:500]}.sig", "s1"), (3, "z" * 300, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.weigh_secrets(docs, keep=("doc_id",)).collect()}
    assert [(got[i].n_live, got[i].n_copied) for i in (1, 2, 3)] == [(1, 0), (1, 0), (0, 0)]
    assert [(s["start"], s["stop"]) for s in got[1].found] == [(4, 4 + len(long))]
    masked = {r.doc_id: r.text for r in secrets.mask_live(docs).collect()}
    assert masked == {1: "key [SECRET] end", 2: "jwt eyJhbGci.[SECRET].sig", 3: "z" * 300}


def test_ownership_by_brute_force(spark):
    """Counts of owners and repositories over the given documents, candidate by candidate."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "concat_ws('/', source, lang) AS repository")
    rows = docs.collect()
    holders = {}
    for r in rows:
        base = secrets.base_spans(r.text or "")
        for k, a, b, v in base + secrets.random_spans(r.text or "", base):
            held = holders.setdefault(hashlib.sha256(r.text[v:b].encode()).hexdigest(), (set(), set()))
            held[0].add(r.source)
            held[1].add((r.source, r.repository))
    live = {h for h, (owners, repositories) in holders.items() if len(owners) <= 1 and len(repositories) <= 1}
    assert live and len(live) < len(holders)
    got = {r.doc_id: r for r in secrets.weigh_secrets(docs, repository="repository", most_owners=1, most_repositories=1, keep=("doc_id",)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = secrets.base_spans(r.text or "")
        spans = [(k, a, b, hashlib.sha256(r.text[v:b].encode()).hexdigest()) for k, a, b, v in base + secrets.random_spans(r.text or "", base)]
        want = sorted((a, k, b, h in live) for k, a, b, h in spans if h in live or k != "random")
        assert sorted((s["start"], s["kind"], s["stop"], s["live"]) for s in got[r.doc_id].found) == want
