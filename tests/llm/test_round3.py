"""Whitening, license scans and fill-in-the-middle against brute force, and odd input."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill, licenses, queries, whitening

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


# Fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(11)
    some = ["", None, "a", " ", "é", "aé", "éa", "\U0001f600\U0001f601ab", "abc", "  ", "a<P>b", "<", "<<", "a<P", "S>b<S>", "\x00a\x00", "naïve café", "x" * 50, "\n\n\n"]
    letters = string.ascii_letters[:6] + " .,<>PSM\né日\U0001f600"
    some += ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(400)]
    some += ["word, " * 200_000, "z" * 1_200_000, "é" * 700_000]
    return some


def test_infill_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id here"), (3, "one again"), (3, "one again")]
    got = infill.fill_in_middle(spark.createDataFrame(rows, DOCS)).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted(((d, *plain_infill(d, t), t or "") for d, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_query_of_whole_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_fill_in_middle"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        n, form, p, m, out = plain_infill(d["doc_id"], d["text"])
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], n, form, p, m, digest(out), digest(d["text"] or ""))


def test_infill_of_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], DOCS + ", n long, form string, output string, h1 int")
    assert infill.fill_in_middle(empty).count() == 0
    one = spark.createDataFrame([(1, "some text", 2, "x", "y", 3)], empty.schema)
    assert infill.fill_in_middle(one).first()["n"] == 3


# Licenses


def plain_base(text):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def notice(label, k=0):
    return [t.replace("#", "") for t, x in licenses.NOTICES if x == label][k]


def licensed():
    mit, apache = notice("mit"), notice("apache-2")
    inserted = mit.split()
    for at in (60, 40, 15):
        inserted.insert(at, "certain")
    return [
        (0, "Released under the MIT License.", {"mit"}), (1, "CC-BY-NC 4.0 and cc by nc, cc_by_nc; by cc by nc", {"cc-by-nc"}), (2, None, set()), (3, "", set()),
        (4, "Licensed under the Apache License, Version 2.0. " * 3, {"apache-2"}), (5, "under the Mit Licensé", set()), (6, "under the MİT License", set()),
        (7, f"x y z {mit} tail", {"mit"}), (8, " ".join(inserted), {"mit"}), (9, " ".join(mit.split()[:40]), set()), (10, re.sub(r"\s+", "\n * ", notice("bsd")), {"bsd"}),
        (11, "This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}), (12, "This work is licensed under the GNU General Public License, version 2.", {"gpl-2"}),
        (13, "licensed under the GNU General Public License, version 1", set()), (14, notice("gpl-3"), {"gpl-3"}), (15, f"{apache} and {notice('isc')}", {"apache-2", "isc"}),
        (16, "of the software and of the software " * 3000, set()), (17, "word " * 300_000 + "under the mit license" + " word" * 10, {"mit"}), (18, "the MIT license", set()),
        (19, "This is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"cc-by-nc"}), (20, "\U0001f600 cc by nc日 cc by nc", {"cc-by-nc"}),
        (21, notice("gpl-3").replace("General", "Lesser General"), {"lgpl"}),
    ]


def test_license_base_places_and_labels(spark):
    rows = [(d, t) for d, t, _ in licensed()] + [(None, "under the mit license"), (0, "Released under the MIT License."), (0, "another text of one id")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    base = lambda r: sorted((p["start"], p["label"]) for p in r["places"] if p["base"])
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["n_words"], base(r)) for r in got), key=key) == sorted(((d, *plain_base(t)) for d, t in rows), key=key)
    labels = {r["doc_id"]: {p["label"] for p in r["places"]} for r in got if r["doc_id"]}
    assert labels == {d: want for d, _, want in licensed() if d}
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[7] == 1.0 and 0.8 <= score[8] < 1 and 0.2 < score[9] < 0.8 and score[3] == 0.0 and all(0 <= s <= 1 for s in score.values())
    span = next(p for r in got if r["doc_id"] == 7 for p in r["places"])
    assert (span["start"], span["end"] - span["start"]) == (3, len(plain_base_words(notice("mit"))))


def plain_base_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())


def test_license_query_of_whole_documents(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_licenses"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, places = plain_base(d["text"])
        r, starts = got[d["doc_id"]], [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert any("gpl-3" in r["labels"] for r in got.values())


def test_licenses_of_own_templates_and_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS + ", h int, words int, template int, n_words int")
    assert licenses.scan_licenses(empty).count() == 0
    own = [licenses.Template.of("one two three four five six", "own"), licenses.Template.of("a b c", "abc", True)]
    one = spark.createDataFrame([(1, "ONE two three, four five six a B c", 1, 2, 3, 4)], empty.schema)
    r = licenses.scan_licenses(one, own).first()
    assert [(p["label"], p["start"], p["end"]) for p in r["places"]] == [("own", 0, 6), ("abc", 6, 9)]
    with pytest.raises(ValueError):
        licenses.Template.of("too short", "x")


# Whitening


def plain_whitening(rows, k=4):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    centre = fit - np.array(s) / n
    e, vectors = np.linalg.eigh(centre.T @ centre / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        w = (np.array(x) - np.array(s) / n) @ vectors[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((n, sum((n * v - t) ** 2 for v, t in zip(x, s)), w, e[:k] / e.sum()))
    return out


def compare(got, want, k=4):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(by) == set(want)
    signs = None
    for i, own in want.items():
        assert sorted(by[i]) == list(range(1, k + 1)) and all(len(rs) == len(own) for rs in by[i].values())
        w = np.array([by[i][c][0]["whitened"] for c in range(1, k + 1)])
        n, deviation, target, explained = own[0]
        if signs is None and np.all(np.abs(target) > 1e-3):
            signs = np.sign(w * target)
        r = by[i][1][0]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
        assert [by[i][c][0]["explained"] for c in range(1, k + 1)] == pytest.approx(explained, rel=1e-9)
        assert np.abs(w) == pytest.approx(np.abs(target), abs=1e-7)
        if signs is not None:
            assert w == pytest.approx(signs * target, abs=1e-7)


def test_whitening_of_all_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op11_whitening"](spark, SF).collect(), plain_whitening(rows))


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 3, 6).tolist()) for i in range(300)]
    rows += [(i, rows[i % 5][1]) for i in range(300, 700)]  # a few vectors hold most rows
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [-0.0, 0.0, -1e-9, 5.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows + [(906, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(13)
    compare(whitening.whiten(df).collect(), plain_whitening(rows))


def test_whitening_of_few_or_flat_vectors(spark):
    schema = "vec_id long, embedding array<double>, component int, x string, n int"
    make = lambda vectors: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], schema)
    for none in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, []]):
        assert whitening.whiten(make(none)).count() == 0
    line = whitening.whiten(make([[float(i), 2.0 * i, 0.0] for i in range(10)])).collect()  # rank 1
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1.0)
    far = whitening.whiten(make([[1e12, 0.0], [-1e12, 1.0], [0.0, 7.0]])).collect()
    assert all(r["deviation"] is None for r in far if r["vec_id"] < 2) and far[0]["identity_error"] < 1e-4
