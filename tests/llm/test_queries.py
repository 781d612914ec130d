"""The registered queries on one small table with odd rows, against plain Python, the tokenizers library and SQL."""

import hashlib
import html
import math
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from assay.llm import langmask, licenses, parity_join, queries, warc
from tests.llm.conftest import DOCS, prose
from tests.llm.test_parity_join import components
from tests.llm.test_rules_mix_lang import base, targets

TONGUES = {"en": "the harbour master wrote of ropes and winter quays", "de": "der schiffer schrieb über grüne taue und häfen im winter", "fr": "le maître du port écrivait sur les cordes et les quais"}
NOTICES = [
    "Licensed under the Apache License, Version 2.0", "CC BY-SA 4.0 all rights reserved", "GNU General Public License version 3 or later", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy",
    "all rights reserved. ALL RIGHTS RESERVED! cc-by", "SPDX-License-Identifier: BSD-3-Clause, see the LICENSE file",
]


def documents():
    r = random.Random(11)
    rows = []
    for i in range(160):
        lang = list(TONGUES)[i % 3]
        words = TONGUES[lang].split()
        text = " ".join(r.choice(words) + (str(r.randrange(9)) if r.random() < 0.2 else "") for _ in range(r.randrange(3, 90)))
        if i % 9 == 0:
            text += "\n" + r.choice(NOTICES) + "\n" + r.choice(NOTICES)
        if i % 11 == 0:
            text = "\n".join([text, text, "### $$$ BUY || NOW %% " * 6])
        if i % 13 == 0 and rows:
            text = rows[-1][1] + " again"
        rows.append((i, text, lang if i % 7 else None, f"s{i % 5}" if i % 10 else None, len(text)))
    odd = [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \t\n", "fr", "s0", 3), (903, "12 $$ --", "de", "s2", 8), (904, prose(4, 30_000), "en", "s1", 1), (905, "q" * 5000, "en", "s3", 5000)]
    odd += [(906, "日本 😀 <|endoftext|> naïve", "en", "s4", 9), (3, rows[3][1], rows[3][2], rows[3][3], rows[3][4]), (None, rows[5][1], "en", "s0", 1), (907, rows[6][1].upper(), "en", "s0", 1)]
    return rows + odd


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("$$$" not in t), 0) for i, t, *_ in documents() if i is not None and t and i % 2 == 0 and i < 900]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def pages():
    r = random.Random(2)
    out = []
    for i in range(40):
        body = "".join(f"<{t}>{html.escape(prose(i + k, 12))}<a href='/p?x={k}&amp;y=2'>l{k}</a> <b>b</b></{t}>" for k, t in enumerate(r.choices(["p", "div", "li", "h2"], k=5)))
        out.append((i, f"http://h{i % 3}/{i}", f"<!DOCTYPE html><html><head><title>T {i} &lt;</title><style>p {{}}</style><script>if (a < 1) {{}}</script></head><body>{body}<!-- no --><img src=\"i.png\" alt='>'></body></html>"))
    return out + [(90, None, None), (91, "u", ""), (92, "u", "plain & simple")]


def by_id(df, rows=None):
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append(r)
    assert {k: len(v) for k, v in got.items()} == Counter(x[0] for x in documents())
    return got


def each(got):
    """(row of the result, text) for every document; rows that repeat an id have the same text here."""
    texts = {i: t for i, t, *_ in documents()}
    return [(r, texts[i]) for i, rows in got.items() for r in rows]


def remainder(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def test_op1(spark, sf, tmp_path):
    got = by_id(queries.op1_pu_quality(spark, sf))
    for r, _ in each(got):
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # nothing is learned from the labels of held-out rows, nor from other columns
    spark.createDataFrame([(i, t, "xx", "s", 0) for i, t, *_ in documents()], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(x["doc_id"], 1 - x["quality"] if remainder(x["doc_id"], 5) == 0 else x["quality"], 1) for x in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    other = by_id(queries.op1_pu_quality(spark, str(tmp_path)))
    assert all(math.isclose(a["score"], b["score"], abs_tol=1e-6) for i in got for a, b in zip(got[i], other[i]))
    text = {t: r["score"] for r, t in each(got)}
    assert all(math.isclose(r["score"], text[t], abs_tol=1e-12) for r, t in each(got))


def test_op2_and_op6(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted, coded = by_id(queries.op2_token_count(spark, sf)), by_id(queries.op6_bpe_round_trip(spark, sf))
    for (a, text), (b, _) in zip(each(counted), each({i: coded[i] for i in counted})):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (a["n_bytes"], a["n_tokens"], a["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 512)
        assert b["n_tokens"] == len(ids) and b["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert b["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.links, self.hidden = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.links += tag in warc.LINKS and any(k in warc.ADDRESS for k, _ in attrs)
        self.hidden += tag in warc.HIDDEN
        self.text.append("\n" * (tag in warc.BREAK))

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.text.append("\n" * (tag in warc.BREAK))

    def handle_data(self, data):
        self.text += [data] * (not self.hidden)


def test_op3(spark, sf):
    got = {r["page_id"]: r for r in queries.op3_warc_derivatives(spark, sf).collect()}
    assert len(got) == len(pages())
    for i, url, source in pages():
        plain = Visible()
        plain.feed(source or "")
        plain.close()
        lines = [" ".join(x.split()) for x in "".join(plain.text).split("\n")]
        assert got[i]["text"] == "\n".join(x for x in lines if x) and got[i]["n_links"] == plain.links
        data = warc.response(url, source)
        assert got[i]["refers_to"] == dict(warc.head(data, "WARC/")[0])["WARC-Record-ID"] and got[i]["digest_ok"] and got[i]["error"] is None
        assert got[i]["metadata_sha256"] == hashlib.sha256(warc.derive(data)["metadata_record"]).hexdigest()


def test_op4(spark, sf):
    for r, text in each(by_id(queries.op4_media_sniffing(spark, sf))):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(raw), len(payload), len(payload) + 44, zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and len(r["media_sha256"]) == 64 and r["feature"].startswith("text/plain>audio/wav@44+")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT k, i, ws[i:i + 4] AS five, ws FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT k, five FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT win.k, unnest(range(i, i + 5)) AS j FROM win JOIN twice USING (k, five)) GROUP BY k),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k)
SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN dup USING (k) LEFT JOIN covered USING (k)"""


def sql(sf, text):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
        return c.execute(text).fetchall()


def test_op5(spark, sf):
    got = by_id(queries.op5_ngram_rules(spark, sf))
    for r, text in each(got):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text)
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= -0.15)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(sql(sf, BASE_SQL), key=key) == sorted((tuple(r[c] for c in columns) for r, _ in each(got)), key=key)


LINKS_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [w[i:i + 3] FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)"""


def test_op7(spark, sf):
    got = by_id(queries.op7_parity_join(spark, sf))
    want = components({i: t for i, t, *_ in documents() if i is not None}.items(), 4, 85, 100)
    assert all((r["n_shingles"], r["component_id"]) == want[i] for i, rows in got.items() for r in rows if i is not None)
    assert got[None][0]["component_id"] is None
    links = sql(sf, LINKS_SQL)
    assert len(links) > 5 and all(want[a][1] == want[b][1] for a, b in links)
    root = {i: i for i in want}
    for a, b in links * 3:  # components by the links of SQL, on a table this small
        low = min(root[a], root[b])
        root = {i: low if x in (root[a], root[b]) else x for i, x in root.items()}
    assert {i: c for i, (_, c) in want.items()} == root


def trigram_list(text):
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    return [w[k : k + 3] for w in (f" {x} " for x in folded.split()) for k in range(len(w) - 2)]


def test_op8(spark, sf):
    """Plain sets of trigrams in place of the filters: no false positives, so the corrected shares come near."""
    counts = defaultdict(Counter)
    for i, t, lang, *_ in documents():
        if lang is not None and i is not None and remainder(i, 3) != 1:
            counts[lang].update(trigram_list(t))
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = Counter()
    for s in share.values():
        for g, v in s.items():
            best[g] = max(best[g], v)
    has = {k: {g for g, v in s.items() if v >= 2e-6 and v >= 0.5 * best[g]} for k, s in share.items()}
    names, common = sorted(has), max(sorted(counts), key=lambda k: sum(counts[k].values()))
    for r, text in each(by_id(queries.op8_language_masks(spark, sf))):
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1)
        grams = trigram_list(text)
        hits = {k: sum(g in has[k] for g in grams) for k in names}
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif not any(hits.values()):
            assert r["lang_pred"] == common or r["score"] < 1
        else:
            ranked = sorted(hits.values())
            if ranked[-1] - ranked[-2] > 0.05 * len(grams):
                assert hits[r["lang_pred"]] == ranked[-1] and abs(r["score"] - ranked[-1] / sum(ranked)) < 0.05
    long = [(" ".join(TONGUES["de"].split()[i % 10] for i in range(5000))), "a" * 3000]
    whole, cut = langmask.Filter(names, np.full((1, 4096), 7, "uint64"), 0), langmask.PIECE
    want = whole.classify(long)
    langmask.PIECE = 100
    try:
        assert whole.classify(long[:1])[0] == want[0][:1]
    finally:
        langmask.PIECE = cut


def test_op9(spark, sf):
    """Every rule on every text without keywords, and suppression by its definition, interval by interval."""
    rules = licenses.build_rules()
    for r, text in each(by_id(queries.op9_license_scan(spark, sf))):
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "")).split(" ")
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words if w]
        places = {(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()}
        at = sorted(i for i, _ in places)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        joined = (" " + " ".join(words) + " ").encode()
        found = sorted((rule.priority, m.start(), -m.end(), k) for k, rule in enumerate(rules) for m in rule.pattern.finditer(joined)) if len(words) < 5000 else []
        kept = []
        for priority, start, end, k in found:
            if not any(s <= start and -end <= e for _, s, e, _ in kept):
                kept.append((priority, start, -end, k))
        if len(words) < 5000:
            assert set(filter(None, r["labels"].split(","))) == {rules[k].label for *_, k in kept} | {x for _, x in places}
        assert 0 <= r["score"] <= 1


SIZES_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) FROM d"""


def test_op10(spark, sf):
    got = by_id(queries.op10_source_mix(spark, sf))
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(sql(sf, SIZES_SQL), key=key) == sorted(((r["doc_id"], r["size"], r["source_size"]) for r, _ in each(got)), key=key)
    source, per, taken = {i: s for i, _, _, s, _ in documents()}, defaultdict(int), defaultdict(int)
    for r, _ in each(got):
        per[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["shards"]) <= 3
    want = targets(per)
    for r, _ in each(got):
        assert math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)
    assert len({x for r, _ in each(got) for x in r["shards"]}) > 3


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    others = {"embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
    for name, schema in others.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_stages_keep_columns_and_odd_rows(spark, sf):
    """Extra columns with clashing names, nulls and repeated rows pass the filtering stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.lit(n) for n in ("cls", "th", "x", "words", "kept", "score", "nth", "shard", "a.b")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.collect() for n in ("cls", "th", "x", "words", "kept", "score", "nth", "shard", "a.b")), name


def test_no_text_is_lost_under_repeated_ids(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (8, c + " d"), (None, c), (None, "e f g h i j"), (None, "e f g h i j"), (9, ""), (9, a), (10, None), (None, None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])).repartition(4)
    got = Counter((r["doc_id"], r["component_id"], r["n_shingles"] > 0) for r in parity_join.near_duplicates(df, spark).collect())
    assert got == Counter({(3, 3, True): 1, (5, 3, True): 2, (7, 3, True): 1, (8, 8, True): 3, (9, 3, False): 1, (9, 3, True): 1, (10, 10, False): 1, (None, None, True): 3, (None, None, False): 1})
    kept = Counter(tuple(r) for r in parity_join.one_of_each_group(df, spark).collect())
    assert kept - Counter({(8, c): 1, (8, c + " d"): 1}) == Counter({(3, a): 1, (5, b): 1, (None, "e f g h i j"): 1, (9, ""): 1, (10, None): 1, (None, None): 1})
    assert kept[(8, c)] + kept[(8, c + " d")] == 1
    assert parity_join.one_of_each_group(df.limit(0), spark).count() == 0
