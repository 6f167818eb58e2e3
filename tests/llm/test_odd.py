"""Texts over a megabyte, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_exact import BASE, valid
from test_models import docs as known  # noqa: F401  a fixture
from test_models import made

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def big():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(4000)]
    return " ".join(rng.choice(words) for _ in range(190_000))


def test_texts_of_a_megabyte(spark, big):
    from tidemark.llm.decontamination import leaks
    from tidemark.llm.lines import dedup_lines
    from tidemark.llm.repeats import remove_repeats
    from tidemark.llm.setjoin import near_duplicates
    from tidemark.llm.sharding import shard

    assert len(big) > 1_200_000
    tail = " And then " + "".join(random.Random(1).choices("KLMNOP", k=500))
    lined = big.replace(" ", "\n", 190_000).replace("\n", " ", 90_000)
    rows = [(1, big), (2, big + tail), (3, big[5000:]), (4, lined), (5, "short text"), (6, lined + "\nEND OF IT ALL")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)

    shards = shard(df, 3).collect()
    assert sorted((r["doc_id"], r["size"]) for r in shards) == [(d, len(t) + 1) for d, t in rows]

    repeats = {r["doc_id"]: r for r in remove_repeats(df, whole=False).collect()}
    assert (repeats[1]["n_removed"], repeats[2]["n_removed"], repeats[2]["n_spans"], repeats[3]["n_removed"]) == (0, len(big), 1, len(big) - 5000)
    assert repeats[2]["kept"] == hashlib.sha256(tail.encode()).hexdigest()

    lines = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    long = sum(len(x.strip()) >= 10 for x in lined.split("\n"))
    assert (lines[4]["n_dropped"], lines[6]["n_dropped"], lines[6]["n_lines"]) == (0, long, lined.count("\n") + 2) and lines[6]["text"].endswith("END OF IT ALL")

    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}

    at = len(big) // 2
    item = " ".join(f"unheard{i}" for i in range(30))
    held = spark.createDataFrame([(1, big), (2, f"{big[:at]} {item.upper()} {big[at:]}"), (3, "x")], SCHEMA)
    found = leaks(held, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(2, 9)]


def test_personal_data_of_long_texts_and_repeated_rows(spark, big):
    from tidemark.llm.pii import BASE as KINDS
    from tidemark.llm.pii import find_personal_data, joined

    text = big[:400_000] + " call +1 (743) 555-3824 or x.y@z.org " + big[400_000:800_000] + " 4111 1111 1111 1111 at 10.0.0.255 and 10.0.0.256 " + big[800_000:900_000]
    df = spark.createDataFrame([(1, text), (1, text), (2, "1.2.3.4"), (2, "other")], SCHEMA)
    got = [(r["doc_id"], r["base"]) for r in find_personal_data(df).select("doc_id", joined(F.filter("spans", lambda s: s["kind"].isin(*KINDS))).alias("base")).collect()]
    spans = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if valid(kind, m.group()))
    want = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    assert len(spans) == 4 and sorted(got) == sorted([(1, want), (1, want), (2, "ip:0:7"), (2, "")])


def test_models_on_clashing_columns_repeated_rows_and_empty_tables(spark, known):  # noqa: F811
    from tidemark.llm.language import fit_language, identify
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    language = fit_language(known)
    toxicity = fit_toxicity(known.drop("toxic"), known.select("doc_id", "toxic"), language)
    clash = "doc_id long, text string, score string, predicted string, lang_pred string, family string, held_out int"
    rows = [(1, "der die und sch", "a", "b", "c", "d", 1), (1, "der die und sch", "a", "b", "c", "d", 1), (1, "the of idiotic", "a", "b", "c", "d", 1), (None, "les que eau", "a", "b", "c", "d", 1)]
    for run, model in ((identify, language), (score_toxicity, toxicity)):
        assert run(spark.createDataFrame([], clash), model).count() == 0
        out = run(spark.createDataFrame(rows, clash), model).collect()
        assert len(out) == 4 and all(0 <= float(r["score"]) <= 1 for r in out)
    told = identify(spark.createDataFrame(rows, clash), language).collect()
    assert sorted(r["lang_pred"] for r in told if r["doc_id"] == 1)[:2] == ["de", "de"] and [r["lang_pred"] for r in told if r["doc_id"] is None] == ["fr"]
    judged = score_toxicity(spark.createDataFrame(rows, clash), toxicity).collect()
    assert sorted(int(r["predicted"]) for r in judged) == [0, 0, 0, 1]


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, "s", len(t), "x", 7) for i, t, lang, _ in made(40, 9)]
    rows += rows[:3] + [(None, rows[4][1], "en", "s", 1, "x", 7)]
    schema = SCHEMA + ", lang string, source string, n_chars long, score string, piece int"
    bench = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string")
    for name, part in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) > 0) == bool(part)
        pieces = {}
        for r in out:
            pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in pieces.values():
            own.sort()
            assert sum(n for _, n in own) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
