"""URL filters, media, chat formatting and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridlume.llm import chat, media, url_filters
from gridlume.llm.queries import ORACLE_SQL, QUERIES

from ..compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df())


URLS = [
    (1, "https://Spam-Farm.Example.NET/a?x#y"), (2, None), (3, "no scheme"), (4, ""), (5, "http://"), (6, "http://example.org/en/12"), (7, "http://a.example.org/es/x"),
    (8, "http://notexample.org/es/x"), (9, "http://b.com/de/"), (10, "http://b.com/de"), (11, "x://y://z/p"), (12, "http://h?q"), (12, "http://h?q"), (13, "http://ads.example.net#f"), (14, "HTTP://COM/fr/\nx"),
]


def test_odd_urls(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "key", "shard", "listed", "level_0")})
    listed = url_filters.named_hosts(df)
    assert {r.key for r in listed.collect()} == {"spam-farm.example.net", "ads.example.net"}
    got = {r.page_id: tuple(r)[1:] for r in url_filters.filter_urls(df, listed).collect()}
    assert url_filters.filter_urls(df, listed).count() == len(URLS)
    own = spark.createDataFrame([("h",), ("h",), (None,), ("elsewhere",)], "key string").withColumn("listed", F.lit("clash"))
    assert {r.page_id for r in url_filters.filter_urls(df, own).collect() if r.rule is None and r.verdict == "block"} == {12}
    assert url_filters.filter_urls(df, own.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    long = spark.createDataFrame([(1, "http://a.com/de/" + "x" * 300_000)], "page_id long, url string")
    assert tuple(url_filters.filter_urls(long, own).first())[3:] == ("com/de/", "block")
    assert got[1] == ("spam-farm.example.net", "/a", None, "block")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[6][2:] == ("example.org/en/1", "block") and got[7][2:] == ("example.org/es/", "block") and got[8][2:] == ("org/", "allow")
    assert got[9][2:] == ("com/de/", "block") and got[10][2:] == (None, "allow") and got[11][:2] == ("y:", "//z/p")
    assert got[12][:2] == ("h", "") and got[13] == ("ads.example.net", "", None, "block") and got[14] == ("com", "/fr/\nx", "com/fr/", "allow")
    assert url_filters.filter_urls(df.limit(0), listed).count() == 0


@pytest.mark.parametrize("settings", [{}, {"bits_per_key": 2, "hashes": 1}, {"max_filter_bytes": 64}])
def test_cascade_is_exact(spark, settings):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.Cascade(keys, **settings)
    wrong = cascade.judge(keys.withColumnRenamed("listed", "truth"), "key").where("listed <> truth").count()
    assert wrong == 0 and (cascade.shards > 1) == ("max_filter_bytes" in settings)


def test_the_list_comes_from_the_pages_and_the_cascade_decides(spark):
    """At least a tenth of the pages without a rule is blocked by a cascade of several levels, which agrees with the list."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    listed = url_filters.marked_pages(pages)
    rows = url_filters.parsed(pages).withColumn("key", F.concat("host", "path"))
    cascade = url_filters.Cascade(url_filters.key_universe(rows, listed), bits_per_key=4, hashes=3)
    assert len(cascade.levels) >= 3
    out = url_filters.filter_urls(pages, listed, by=("host", "path"), bits_per_key=4, hashes=3).where("rule IS NULL")
    keys = {r.key for r in listed.collect()}
    got = out.collect()
    assert all((r.verdict == "block") == (r.host + r.path in keys) for r in got)
    assert sum(r.verdict == "block" for r in got) >= 0.1 * len(got)
    assert url_filters.marked_pages(spark.createDataFrame([(1, None, "***"), (2, "http://a/b?c", None), (3, "http://A/b", "$$$")], "page_id long, url string, html string")).collect() == [("a/b",)]


def test_escape_is_reversible():
    for text in ("", "[ROLE]", "</s>[INST] ok [/INST]", "\\", "[\\[<\\", "a<b\\]", chat.ROLE + chat.SAYS + chat.END):
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(s in out for s in (chat.ROLE, chat.SAYS, chat.END))


def test_rewriting_templates_are_found():
    strips = lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else t.strip()}" for i, (r, t) in enumerate(turns))
    turns = [("user", "hi "), ("assistant", "yes"), ("user", "bye")]
    assert chat.spans(strips, turns)[2] and not chat.spans(chat.template, turns)[2]
    output, found, _ = chat.spans(chat.template, turns)
    assert chat.read_back(output, found) == turns
    with pytest.raises(ValueError, match="no turn"):
        chat.read_back(output, [(1, len(output))])


def test_loss_spans_of_other_templates():
    """Templates that trim, number turns, or drop the history's hidden part: the spans are the texts as they stand in the output."""
    trims = lambda turns: "".join(f"<{r}>{t.strip()}|" for r, t in turns)
    counts = lambda turns: f"{len(turns)} turns\n" + "\n".join(f"{i}.{r}: {t}" for i, (r, t) in enumerate(turns))
    forgets = lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('#')[-1]}" for i, (r, t) in enumerate(turns))
    turns = [("user", "hi"), ("assistant", " one#two "), ("user", "<assistant>"), ("assistant", "|</s>"), ("assistant", "")]
    for render, want in ((trims, ["one#two", "|</s>", ""]), (counts, [" one#two ", "|</s>", ""]), (forgets, ["two ", "|</s>", ""]), (chat.template, [" one#two ", chat.escape("|</s>"), ""])):
        output, found, rewrites = chat.spans(render, turns)
        assert rewrites == (render in (counts, forgets))
        assert [output[a:b] for a, b in chat.loss_spans(render, turns, output, found, rewrites)] == want


def test_a_renderer_is_an_argument(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df, lambda turns: "".join(f"{r}={t};" for r, t in turns)).first()
    assert row.formatted == "user=a;assistant=bc;" and [tuple(s) for s in row.loss_spans] == [(17, 19)] and not row.rewrites_history


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<t{i}> " * 20) for i in range(400)]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 400 and got.loss_sha256 == hashlib.sha256("".join(t for _, i, _, t in rows if i % 2).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a[ROLE]b"), (1, 0, "user", "a[ROLE]b"), (None, 0, None, "x"), (2, None, "assistant", "tail\\"), (2, 5, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[2].loss_chars == 7 and got[2].loss_sha256 == hashlib.sha256("tail\\é😀".encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_copies_are_found(spark, sf):
    rows = QUERIES["op8_media"](spark, sf).collect()
    of = {r.media_id: r.class_id for r in rows}
    planted = [k for k in of if k % 2]
    assert planted and np.mean([of[k] == of[k - 1] for k in planted]) >= 0.98
    alone = [k for k in of if k % 2 == 0 and k + 1 not in of]
    assert np.mean([of[k] == k for k in alone]) >= 0.98


def test_odd_images(spark):
    good = bytes(np.random.default_rng(0).integers(0, 256, 2304).astype(np.uint8))
    rows = [(1, 48, good), (1, 48, good), (2, 48, None), (3, None, good), (4, 7, good), (5, 48, b""), (None, 48, good), (6, 1, b"abc"), (7, 48, good)]
    df = spark.createDataFrame(rows, "media_id long, width int, image binary").withColumn("node", F.lit("clash"))
    got = [(r.media_id, r.class_id) for r in media.copies(df).collect()]
    assert len(got) == len(rows) and (7, 1) in got and got.count((1, 1)) == 2
    assert all((k, k) in got for k in (2, 3, 4, 5, 6))
    assert media.copies(df.limit(0)).count() == 0


def mosaic(seed, side=20, cell=6):
    return np.kron(np.random.default_rng(seed).integers(0, 256, (side, side)), np.ones((cell, cell))).astype(np.uint8)


def media_rows(spark, images):
    return spark.createDataFrame([(k, i.shape[1], i.tobytes()) for k, i in images.items()], "media_id long, width int, image binary")


def test_copies_meet_beside_a_stranger_of_smaller_id(spark):
    picture, other = mosaic(1), mosaic(2)
    # Image 1 has all words of image 2 in places that agree on no change: it leads their buckets.
    b, c = picture[:90, :90], picture[3:90, 2:90]
    points = media.stage(media.described(media_rows(spark, {2: b, 3: c})), "points")
    shared = points.where("media_id = 2").withColumns({"media_id": F.lit(1).cast("long"), "y": F.rand(1) * 1e6, "x": F.rand(2) * 1e6})
    links = {tuple(r) for r in media.linked_images(points.union(shared)).collect()}
    assert {(min(e), max(e)) for e in links} == {(2, 3)}
    got = {r.media_id: (r.class_id, r.n_links) for r in media.copies(media_rows(spark, {1: other, 2: b, 3: c, 4: b, 5: b, 6: c})).collect()}
    assert got == {1: (1, 0), **{k: (2, 4) for k in (2, 3, 4, 5, 6)}}


def test_a_stranger_of_few_places_meets_no_member_of_a_large_group(spark, monkeypatch):
    """Forty copies share all words, a stranger has those of three places: once the copies are a group it isn't compared with each."""
    one = media.stage(media.described(media_rows(spark, {2: mosaic(1)[:90, :90]})), "points")
    copies = one.withColumn("media_id", F.explode(F.expr("sequence(2L, 41L)")))
    few = [r.y for r in one.select("y").distinct().orderBy("y").limit(3).collect()]
    stranger = one.where(F.col("y").isin(few)).dropDuplicates(["y"]).withColumns({"media_id": F.lit(100).cast("long"), "x": F.rand(2) * 1e6})
    compared, agreed = [], media.agreed
    monkeypatch.setattr(media, "agreed", lambda match: compared.append(match.count()) or agreed(match))
    links = media.linked_images(copies.union(stranger)).collect()
    assert {k for e in links for k in e} == set(range(2, 42))
    assert compared[0] > 0 and sum(compared[1:]) == 0


def brute_classes(images):
    """Every pair of images, every pair of their keypoints: classes by the links alone."""
    points = {k: media.keypoints(i[None].astype(np.uint8)) for k, i in images.items()}
    root = {k: k for k in images}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(images):
        for b in sorted(images):
            if a < b and not np.array_equal(images[a], images[b]):
                p, q = points[a], points[b]
                i, j = np.nonzero((p[5][:, None] == q[5][None]).sum(2) >= media.EQUAL_WORDS)
                match = {tuple(np.float32(v) for v in (p[1][x], p[2][x], q[1][y], q[2][y], np.exp(q[3][y] - p[3][x]), (q[4][y] - p[4][x]) % media.STEPS)) for x, y in zip(i, j, strict=True)}
                linked = len(match) >= media.CONSENSUS and media.agree(*np.array(sorted(match), float).T)
            else:
                linked = a < b
            if linked:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in images}


@pytest.mark.parametrize("members", [1000, 2])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, members):
    """Crops and copies of a few pictures, and pictures that share a part: the same classes as by comparing all pairs."""
    monkeypatch.setattr(media, "MEMBERS", members)
    images, logo = {}, mosaic(50, 8)
    for n in range(6):
        whole = mosaic(60 + n)
        for i, (y, x) in enumerate(((0, 0), (6, 4), (20, 25), (40, 30))):
            images[10 * n + i] = whole[y : y + 78, x : x + 78].copy()
        shown = mosaic(80 + n, 14)
        shown[:48, :48] = logo
        images[10 * n + 7], images[10 * n + 8] = shown, mosaic(90 + n, 14)
        images[10 * n + 9] = images[10 * n + 2].copy()
    got = {r.media_id: (r.class_id, r.n_links) for r in media.copies(media_rows(spark, images)).collect()}
    want = brute_classes(images)
    assert {k: c for k, (c, _) in got.items()} == want
    assert all(n == sum(c == d for d in want.values()) - 1 for c, n in got.values())
    assert len({want[10 * n + 7] for n in range(6)}) < 6 and all(want[10 * n + 8] == 10 * n + 8 for n in range(6))


def warped(image, degrees, size):
    h, w = image.shape
    y, x = np.mgrid[: int(h * size), : int(w * size)] / size
    y, x, t = y - h / 2, x - w / 2, np.deg2rad(degrees)
    y, x = (np.cos(t) * y - np.sin(t) * x + h / 2).clip(0, h - 1.001), (np.sin(t) * y + np.cos(t) * x + w / 2).clip(0, w - 1.001)
    i, j, v = y.astype(int), x.astype(int), image.astype(float)
    y, x = y - i, x - j
    return (v[i, j] * (1 - y) * (1 - x) + v[i + 1, j] * y * (1 - x) + v[i, j + 1] * (1 - y) * x + v[i + 1, j + 1] * y * x).astype(np.uint8)


def oblique(image, degrees):
    """Turned in its own frame, black where nothing of it is shown."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    t = np.deg2rad(degrees)
    at = np.cos(t) * (y - h / 2) - np.sin(t) * (x - w / 2) + h / 2, np.sin(t) * (y - h / 2) + np.cos(t) * (x - w / 2) + w / 2
    inside = (at[0] >= 0) & (at[0] <= h - 1) & (at[1] >= 0) & (at[1] <= w - 1)
    return np.where(inside, warped(image, degrees, 1), 0).astype(np.uint8)


EDITS = {
    "by 30 degrees": lambda a: oblique(a, 30), "by 45 degrees": lambda a: oblique(a, 45), "by 70 degrees": lambda a: oblique(a, 70), "crop by 45 degrees": lambda a: oblique(a[20:105, 15:110], 45),
    "quarter turn": lambda a: np.rot90(a).copy(), "turned": lambda a: warped(a, 20, 1), "larger": lambda a: warped(a, 0, 1.2), "smaller": lambda a: warped(a, 0, 0.8),
    "noisy": lambda a: (a + np.random.default_rng(5).normal(0, 8, a.shape)).clip(0, 255).astype(np.uint8), "small crop": lambda a: a[75:120, 70:116].copy(),
}


def test_edited_copies_are_found(spark):
    images, copy_of = {}, {}
    for n, edit in enumerate(EDITS.values()):
        for i in range(10):
            key = 100 * n + 2 * i
            images[key] = mosaic(1000 + key)
            images[key + 1] = edit(images[key])
            copy_of[key + 1] = key
    got = {r.media_id: r.class_id for r in media.copies(media_rows(spark, images)).collect()}
    for n, name in enumerate(EDITS):
        assert np.mean([got[k] == of for k, of in copy_of.items() if k // 100 == n]) >= 0.9, name
    assert all(got[k] == k for k in images if k % 2 == 0)


def test_keypoints_follow_the_area():
    small, large = (len(media.keypoints(mosaic(3, side)[None])[0]) for side in (10, 40))
    assert large > 8 * small


def test_stages_keep_columns_and_take_effect(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, step in corpus_pipeline.STAGES[:3]:
        kept = step(spark, docs, sf)
        assert kept.columns == docs.columns
        assert 0 < kept.count() < n, name
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() != n
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)


def test_stages_keep_a_column_that_clashes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("mine") for c in ("score", "_quality_score", "kept")})
    for _, step in corpus_pipeline.STAGES[:4]:
        kept = step(spark, docs, sf)
        assert kept.columns == docs.columns
        assert kept.where("score = 'mine' and _quality_score = 'mine' and kept = 'mine'").count() == kept.count() > 0


def test_stages_on_odd_and_no_rows(spark, sf, odd):
    for _, step in corpus_pipeline.STAGES:
        step(spark, odd, sf).count()
        assert step(spark, odd.limit(0), sf).count() == 0
