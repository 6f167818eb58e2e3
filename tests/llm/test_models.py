"""Trained operators by held-out accuracy, image copies, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

LANGUAGES = {"en": "the of and ing tion ther hat was ed", "de": "der die und sch ung keit ein lich ü", "fr": "les que eau oir des une ç tre é", "es": "los que ción ado las ñ una mente ó"}
BAD = ["idiotic", "worthless"]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        own = LANGUAGES[lang].split()
        text = ["".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(6, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(900, 1), "doc_id long, text string, lang string, toxic int").withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("long"), "score": F.lit("clash")})


def test_language(spark, docs):
    from tidemark.llm.language import fit_language, identify

    model = fit_language(docs.where("doc_id % 3 != 1"))
    out = identify(docs.where("doc_id % 3 = 1"), model).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "the und " * 30000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in LANGUAGES
    assert fit_language(docs.limit(0)) is None
    assert {r["lang_pred"] for r in identify(odd, None).collect()} == {"und"}


def test_toxicity(spark, docs):
    from tidemark.llm.language import fit_language
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    known = docs.where("doc_id % 5 != 0")
    model = fit_toxicity(known.drop("toxic"), known.select("doc_id", "toxic"), fit_language(known))
    out = score_toxicity(docs.where("doc_id % 5 = 0"), model).toPandas()
    assert (out.predicted == out.toxic).mean() > 0.95 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "the and " * 30000 + "idiotic")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(odd, model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r["score"] for r in score_toxicity(odd, None).collect()} == {0.0}
    assert fit_toxicity(docs, docs.select("doc_id", "toxic").limit(0), None) is None


def test_image_copies(spark):
    from tidemark.llm import media

    rng = np.random.default_rng(1)
    images = []
    for i in range(6):
        image = (255 * media.stretched(rng.random((1, 16, 16)), 96)[0]).astype(np.uint8)
        images += [(i, image), (100 + i, image[10:86, 8:90]), (200 + i, np.clip(image * 0.8 + 30, 0, 255).astype(np.uint8)), (300 + i, np.rot90(image))]
    images += [(400, images[0][1]), (500, np.zeros((32, 32), np.uint8)), (501, np.zeros((32, 32), np.uint8))]
    rows = [(i, *x.shape, np.ascontiguousarray(x).tobytes()) for i, x in images] + [(600, None, None, None), (601, 5, 5, b"12"), (None, 1, 1, b"1")]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").withColumn("text", F.lit("clash"))
    got = {r["image_id"]: r["component_id"] for r in media.copies(df).collect()}
    assert all(got[k] == i for i in range(6) for k in (i, 100 + i, 200 + i, 300 + i))
    assert got[400] == 0 and got[501] == 500 and got[600] == 600 and got[601] == 601 and None not in got


def test_toxicity_thresholds_follow_class_shares(spark):
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    rng, rows = random.Random(2), []
    for i in range(6000):
        toxic, text = int(rng.random() < 0.1), [rng.choice(("the", "of", "was", "there", "and")) for _ in range(12)]
        text += ["rude"] * (rng.random() < (0.8 if toxic else 0.15)) + ["idiotic"] * (rng.random() < (0.6 if toxic else 0.01))
        rng.shuffle(text)
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for per_class in (6000, 400):
        model = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), None, per_class)
        out = score_toxicity(docs, model).toPandas()
        assert out.predicted[out.text.str.contains("idiotic")].mean() > 0.95
        assert out.predicted[out.toxic == 0].mean() < 0.05


def textured(rng, height, width):
    """An image with details of all sizes."""
    f = np.hypot(np.fft.fftfreq(height)[:, None], np.fft.fftfreq(width))
    f[0, 0] = 1
    image = np.fft.ifft2(np.fft.fft2(rng.normal(size=f.shape)) * f**-1.2).real
    return (255 * (image - image.min()) / np.ptp(image)).astype(np.uint8)


def resized(image, side):
    from tidemark.llm import media

    return media.stretched(image[None].astype(float), side)[0]


def recompressed(image, step):
    """Blocks of 8 x 8 by their cosine coefficients, rounded to ``step``."""
    k = np.arange(8)
    wave = np.cos(np.pi * (2 * k + 1) * k[:, None] / 16) * np.where(k[:, None], 0.5, np.sqrt(1 / 8))
    blocks = image.reshape(len(image) // 8, 8, -1, 8).swapaxes(1, 2).astype(float)
    return (wave.T @ (np.round(wave @ blocks @ wave.T / step) * step) @ wave).swapaxes(1, 2).reshape(image.shape)


def test_tables_recall_edited_copies():
    from tidemark.llm import media

    rng = np.random.default_rng(4)
    blurred = lambda x: media._blur(x[None].astype(np.float32), 2)[0]
    edits = [lambda x: x + rng.normal(0, 30, x.shape), lambda x: recompressed(x, 90), blurred, *(lambda x, n=n: resized(x, n) for n in (61, 67, 86, 106)), lambda x: x[20:80, 15:75]]
    linked, met = np.zeros(len(edits)), np.zeros(len(edits))
    for _ in range(20):
        image = textured(rng, 96, 96)
        one = media.describe(image[None])[0]
        for k, edit in enumerate(edits):
            other = np.clip(edit(image), 0, 255).astype(np.uint8)
            two = media.describe(other[None])[0]
            if media.linked(one, two, image.shape, other.shape):
                linked[k] += 1
                (a, x), (b, y) = media.table_keys(one), media.table_keys(two)
                i, j, t = np.nonzero(a[:, None] == b[None])
                met[k] += bool((np.bitwise_count(x[i, t] ^ y[j, t]) <= media.CLOSE).any())
    assert (linked >= 15).all() and (met >= 0.9 * linked).all()


def test_copies_against_all_pairs(spark, monkeypatch):
    """All pairs of 60 images: the query's components are those of all verified links; no hub changes them."""
    from tidemark.llm import media

    rng, images = np.random.default_rng(12), []
    for i in range(12):
        image = textured(rng, 64, 64).astype(float)
        parts = [image, image[6:58, 4:60], np.rot90(image), np.clip(image * 0.7 + 20, 0, 255), resized(image, 45)]
        images += [(10 * i + k, np.ascontiguousarray(np.rint(x)).astype(np.uint8)) for k, x in enumerate(parts)]
    points = {i: media.describe(x[None])[0] for i, x in images}
    parent = {i: i for i, _ in images}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, x in images:
        for j, y in images:
            if i < j and media.linked(points[i], points[j], x.shape, y.shape):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i: find(i) for i, _ in images}
    assert len(set(want.values())) < 20 and image_components(spark, images) == want
    monkeypatch.setattr(media, "HUB_ROUNDS", 0)
    assert image_components(spark, images) == want


def test_rendered_vectors_and_edited_copies(spark):
    from tidemark.llm import media

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(81)] + [(200, None), (201, []), (None, [1.0] * 64), (202, [float("nan")] * 64), (203, [0.5] * 64)]
    images = media.render_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["image_id"]: r["component_id"] for r in media.copies(images).collect()}
    assert {i for i in got if i % 2} == {1, 41, 81, 121, 161}  # 200 is divisible too, but has no vector
    assert all(got[2 * i + 1] == 2 * i for i in (0, 20, 40, 60, 80)) and all(got[2 * i] == 2 * i for i in range(81))


def image_components(spark, images):
    from tidemark.llm import media

    rows = [(i, *x.shape, np.ascontiguousarray(x).tobytes()) for i, x in images]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").repartition(3)
    return {r["image_id"]: r["component_id"] for r in media.copies(df).collect()}


def test_small_crops(spark):
    rng, images = np.random.default_rng(6), []
    for i in range(5):
        image = textured(rng, 200, 200)
        images += [(i, image), (100 + i, image[:100, :100]), (200 + i, image[70:150, 90:170]), (300 + i, np.rot90(image[60:160, 60:160]))]
    assert image_components(spark, images) == {i: i % 100 for i, _ in images}


def test_large_images(monkeypatch):
    from tidemark.llm import media

    rng = np.random.default_rng(8)
    wide, large = textured(rng, 400, 600), textured(rng, 600, 600)
    pairs = [(wide, wide[:, 40:540]), (large, large[50:550, 90:590])]
    one = lambda x: media.describe(x[None])[0]
    assert all(media.linked(one(a), one(b), a.shape, b.shape) for a, b in pairs)
    tiled = np.sort(one(large), order=["scale", "y", "x"])
    monkeypatch.setattr(media, "TILE", 1000)
    whole = np.sort(one(large), order=["scale", "y", "x"])
    assert len(tiled) == len(whole) and all(np.allclose(tiled[c], whole[c], atol=1e-2) for c in ("scale", "y", "x")) and (tiled["bits"] == whole["bits"]).all(1).mean() > 0.99


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = made(60, 4)
    long = " ".join(f"word{i}" for i in range(80))
    rows += [(1000, long, "en", 0), (1001, long.replace("word7 ", "other "), "en", 0), (1002, "12345 !!", "en", 0), (1003, None, None, 0), (1004, "the other thing was " + " ".join(f"item{i}" for i in range(30)), "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("long")}).drop("toxic")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        ids[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    assert not {1002, 1003} & ids["language"] and {1000, 1001, 1004} <= ids["language"]
    assert ids["lines"] == ids["language"]
    assert 1000 in ids["near_duplicates"] and 1001 not in ids["near_duplicates"] and 1004 in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {1004}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids["decontamination"]


def test_queries_are_registered():
    import __spark_entry__
    from tidemark.llm.queries import QUERIES

    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
