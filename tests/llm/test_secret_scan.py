import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tableguard.llm import queries, secret_scan
from tableguard.llm.trigrams import EVERYTHING, trigram_query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
KEY = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", "nothing here", "token = abcdefgh1", "token=short", "TOKEN='Abc/def+12=' and Password: \"hunter2hunter2\"", "token=secret: abcdefgh12345",
    f"é😀 {KEY} {'0f' * 20} secret={'ab' * 20}", "AKIASHORT", KEY * 2, "a" * 31 + " " + "b" * 32, "api_key:12345678 apikey = 'zzzzzzzz' api-key=99999999",
    "x" * 50_000 + " passwd=longenough1 " + "tok" * 9000 + " token: aaaaaaaaa " * 700, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-123456789012", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-12",
]


def base(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32])


def digest(spans):
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_against_brute_force(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[5], None), (None, TEXTS[5], None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, kind string").write.parquet(f"{path}/documents.parquet")
    got = secret_scan.op1_secret_scan(spark, path).collect()
    want = []
    for i, t, _ in rows:
        s = base(t)
        want.append((i, *(sum(k == n for _, k, _ in s) for n in range(3)), digest(s)))
    key = lambda r: repr(tuple(r)[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[13] == "private_key:0:31" and spans[14] == "github:0:40" and spans[15] == "slack:0:17" and spans[16].startswith("jwt:0:")


def test_oracle(spark, data, duck):
    from tests.conftest import same_rows

    same_rows(secret_scan.op1_secret_scan(spark, data), duck.execute(queries.oracle_sql()["op1_secret_scan"]))


def test_redact(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int")
    got = {r.doc_id: r for r in secret_scan.redact(secret_scan.scan_secrets(docs)).collect()}
    assert got[0].text is None and got[1].text == "" and got[2].text == "nothing here"
    assert got[7].text == "é😀 [SECRET] [SECRET] [SECRET]" and got[7].start == 1
    assert not any(base(r.text) for r in got.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan_secrets(docs).count() == 0


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("abcd", {frozenset(["abc", "bcd"])}), ("(abc|xyz)[0-9]+", {frozenset(["abc"]), frozenset(["xyz"])}), ("[0-9a-f]{32,}", EVERYTHING),
        ("ab?cd", {frozenset(["abc", "bcd"]), frozenset(["acd"])}), ("(abc)*", EVERYTHING), ("(abc)+d", {frozenset(["abc"])}),
    ],
)
def test_trigram_query(pattern, query):
    assert trigram_query(pattern) == frozenset(query)


def test_index_skips_texts_without_trigrams(spark):
    docs = spark.createDataFrame([(1, "token: abcdefgh"), (2, "tok oke"), (3, "ordinary")], "doc_id long, text string")
    keyed = docs.withColumn("_key", F.col("doc_id"))
    assert [r._key for r in secret_scan.candidates(keyed, "text").collect()] == [1]


def test_any_number_of_rules(spark):
    """More rules than a long has bits, and one whose trigrams are more than that too."""
    long_name = "".join(chr(97 + k * 7 % 26) + chr(97 + k * 11 % 26) for k in range(40))
    rules = tuple(secret_scan.Rule(f"r{k}", f"word{k:03}x[0-9]+") for k in range(70)) + (secret_scan.Rule("long", long_name),)
    rows = [(k, f"some word{k:03}x77 here") for k in range(70)] + [(70, f"a {long_name} b"), (71, long_name[:-1])]
    got = {r.doc_id: [tuple(x) for x in r._spans] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()}
    assert got == {k: [(5, k, 15)] for k in range(70)} | {70: [(2, 70, 2 + len(long_name))], 71: []}


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "password = abcdefgh1", 5, 6, 7, 8)], "doc_id long, text string, _key int, _row int, _rules int, _merged int")
    out = secret_scan.redact(secret_scan.scan_secrets(docs))
    assert out.columns == docs.columns and tuple(out.first()) == (1, "[SECRET]", 5, 6, 7, 8)
