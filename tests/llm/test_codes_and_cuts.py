"""Fill-in-middle, vector codes and quality rules against brute force, on odd rows, and on no rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridlume.llm import fill_in_middle as fim
from gridlume.llm import quality_rules as rules
from gridlume.llm import vector_codes as codes
from gridlume.llm.queries import ORACLE_SQL, QUERIES

from ..compare import assert_same
from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_vector_codes", "op13_quality_rules"])
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df())


# Fill-in-middle


def ends_of(text):
    return [m.end() for m in re.finditer(r"(?s)[A-Za-z]+|[^A-Za-z]", text)]


@pytest.mark.parametrize("kind", [fim.Members, fim.Bitmap, fim.Runs])
def test_containers_select_every_member(kind):
    pick = random.Random(5)
    for density in (0.001, 0.2, 0.9, 1.0):
        present = np.array([pick.random() < density for _ in range(fim.SPAN)])
        places = np.flatnonzero(present)
        held = kind(present)
        for k in {0, len(places) - 1, *(pick.randrange(len(places)) for _ in range(200))}:
            assert held.select(k) == places[k]


def test_the_smallest_container_is_taken():
    few, all_, mixed = (np.zeros(fim.SPAN, bool) for _ in range(3))
    few[[3, 900, 70]] = True
    all_[:] = True
    mixed[::2] = True
    assert [type(fim.container(x, int(x.sum()))) for x in (few, all_, mixed)] == [fim.Members, fim.Runs, fim.Bitmap]


@pytest.mark.parametrize("length", [0, 1, 5, 65_534, 65_535, 65_536, 65_537, 131_072, 200_001])
def test_boundary_set_holds_every_token_end(length):
    pick = random.Random(length)
    text = "".join(pick.choice("aZbq .\n漢é@[`{1") for _ in range(length))
    text = text[: length // 2] + "x" * (length - length // 2) if length % 2 else text
    want, got = ends_of(text), fim.BoundarySet(text)
    assert len(got) == len(want)
    for k in {0, len(want), *(pick.randrange(len(want) + 1) for _ in range(300))}:
        assert got.offset(k) == ([0, *want][k])


def brute_fim(key, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = [0, *ends_of(text)]
    n = len(ends) - 1
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (ends[x] for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def fim_rows(df):
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect())


def test_fim_of_odd_rows(odd, none):
    assert fim_rows(fim.fill_in_middle(odd)) == Counter((k, *brute_fim(k, t)) for k, t, *_ in TEXTS)
    assert fim.digests(fim.fill_in_middle(none)).count() == 0


def test_fim_restores_texts_around_marks(spark):
    pick = random.Random(2)
    texts = ["".join(pick.choice(["<", ">", "P", "S", "M", "a", "<P", "S>", "é", "\n"]) for _ in range(pick.randrange(40))) for _ in range(600)]
    made = fim.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    back = {r.doc_id: r for r in fim.digests(made).collect()}
    assert {r.form for r in back.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        assert back[i].restored_sha256 == hashlib.sha256(t.encode()).hexdigest()


# Vector codes


def brute_codes(vectors, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    """Codes and errors of integer vectors by comparing each part with each entry."""
    x = np.array(vectors, np.int64).reshape(len(vectors), 4, -1)
    books = x[:entries].swapaxes(0, 1).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        best = nearest()[0]
        for p in range(4):
            for e in range(books.shape[1]):
                mine = x[best[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    best, d = nearest()
    return best, d.sum(axis=1), books


def vectors_of(n, width, seed, spread=200, groups=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, width)) * spread / 1000


@pytest.mark.parametrize("n,width,seed", [(1, 8, 0), (40, 8, 1), (300, 16, 2), (5000, 16, 3)])
def test_codes_are_those_of_brute_force(spark, n, width, seed):
    x = vectors_of(n, width, seed)
    if n > 1000:
        x[::3] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3 if i % 7 else None) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3)
    best, error, books = brute_codes(np.floor(x * 1024))
    got = {r.vec_id: r for r in codes.compress(df).collect()}
    assert len(got) == n
    by_label = Counter()
    for i in range(n):
        by_label[i % 3 if i % 7 else None] += int(error[i])
    for i in range(n):
        assert got[i].code == "".join(f"{b:02x}" for b in best[i])
        assert (got[i].error, got[i].label_error) == (error[i], by_label[i % 3 if i % 7 else None])
        assert got[i].codebooks_sha256 == codes.books_sha256(books)


def test_both_trees_prune_and_assign_whole_nodes():
    x = np.floor(vectors_of(4000, 16, 9, spread=20, groups=8) * 1024).astype(np.int64)
    order = codes.tree_order(x, codes.depth(len(x), codes.LEAF))
    mine = codes.PartTree(x[order], codes.node_table(x[order], codes.depth(len(x), codes.LEAF)))
    best, sums, counts, went = mine.assign(codes.EntryTree(x[:256]))
    d = ((x[order][:, None] - x[None, :256]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and went["whole"] + went["compared"] == len(x)
    assert went["distances"] < 0.5 * 256 * len(x)
    assert counts.sum() == len(x) and (sums.sum(axis=0) == x.sum(axis=0)).all()
    far = np.repeat(np.arange(4)[:, None] * 100_000, 16, axis=1)
    best, *_, went = mine.assign(codes.EntryTree(far))
    assert went["whole"] > 0 and (best == ((x[order][:, None] - far[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_codes_of_odd_vectors(spark):
    bad = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("-inf"), 0.0, 0.0, 0.0], 1), (5, [], 1)]
    good = [(6, [-0.0001, 0.0, 1.0, 2.0], None), (6, [-0.0001, 0.0, 1.0, 2.0], None), (None, [5.0, 5.0, 5.0, 5.0], 2)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in bad + good], "vec_id long, embedding array<double>, label int, code string, error string")
    got = codes.compress(df).collect()
    assert sorted((r.vec_id or -1, r.label, r.error) for r in got) == [(-1, 2, 0), (6, None, 0), (6, None, 0)]
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id = 1")).count() == 0
    assert codes.integers(np.array([-0.0001]))[0] == -1
    with pytest.raises(ValueError):
        codes.integers(np.array([1e6]))


def test_label_errors_by_a_salted_join(spark, monkeypatch):
    coded = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, "00", i) for i in range(100)], "vec_id long, label int, code string, error long")
    want = sorted(map(str, codes.with_label_errors(coded).collect()))
    monkeypatch.setattr(codes, "MOST_LABELS", 0)
    assert sorted(map(str, codes.with_label_errors(coded).select("vec_id", "label", "code", "error", "label_error").collect())) == [w.replace("Row(label", "Row(label") for w in want]


# Quality rules


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    at = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    inside = {j for i in range(n - 2) if at[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    chars, symbols, dup = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(inside) > 50 * n
    letters, capitals = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    bare = sum(not any(c.isalpha() for c in w) for w in words)
    cut, listed = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines), sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines)
    other = chars < 2 * n or chars > 25 * n or 10 * symbols > n or 100 * dup > 30 * len(lines) or 100 * bare > 20 * n or 100 * capitals > 60 * letters or 100 * cut > 30 * len(lines) or 100 * listed > 90 * len(lines)
    return n, chars, symbols, dup, len(inside), failed, not (failed or other)


HARD = [
    (20, " ".join(f"w{i}x" for i in range(60)), None, None),
    (21, " ".join(f"w{i}x" for i in range(50)) + " a b c d a b c a b", None, None),
    (22, "a a a a a a", None, None),
    (23, "# | * " * 40, None, None),
    (24, "\n".join(f"- item number {i} of the list" for i in range(30)), None, None),
    (25, "\n".join(f"line {i} goes on..." for i in range(30)), None, None),
    (26, "THIS IS ALL LOUD " + " ".join(f"W{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)), None, None),
    (27, "same line here\n" * 3 + "  \n\n" + "\n".join(f"other line {i} ok" for i in range(40)), None, None),
    (28, "\x0b\x0c\r x \x1f y\x85z " + "漢字 " * 60, None, None),
]


def judged(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect())


def test_rules_of_odd_rows(spark, odd, none):
    texts = [r[:4] for r in TEXTS] + HARD
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    want = Counter((k, *brute_rules(t)) for k, t, *_ in texts)
    names = tuple(r.name for r in rules.RULES)
    assert judged(rules.judge(df)) == want
    assert judged(rules.judge(df, order=names[::-1])) == want
    assert rules.judge(none).count() == 0
    kept = rules.kept_documents(df.withColumn("_rule_text", rules.F.lit(1)))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, *v in want.elements() if v[-1])
    assert kept.columns == ["doc_id", "text", "lang", "source", "_rule_text"]


def test_rules_are_ordered_by_rejection_per_cost():
    some = tuple(rules.Rule(n, (f,), None) for n, f in (("dear", "n_repeat_words"), ("cheap", "n_symbols"), ("none", "n_letters"), ("same", "n_symbols")))
    costs = {f: 1.0 for f in rules.FEATURES} | {"n_symbols": 0.1}
    rejected = {frozenset(): 50, frozenset({"dear"}): 30, frozenset({"cheap", "dear"}): 20, frozenset({"same"}): 1}
    assert rules.ordered(some, costs, rejected) == ("cheap", "same", "dear", "none")
    assert rules.ordered(some, costs, rejected, ("n_repeat_words",))[0] == "dear"


def test_later_features_are_not_made_of_rejected_texts(spark, monkeypatch):
    """A feature that fails when it is made: the rules before it reject all texts but one, whose feature is not asked for."""
    trap = {"trap": rules.Feature(("text",), lambda f: rules.F.raise_error(rules.F.lit("made")).cast("long"))}
    monkeypatch.setattr(rules, "FEATURES", rules.FEATURES | trap)
    some = (rules.BASE[0], rules.Rule("trap", ("trap",), lambda f: f("trap") > 0))
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert rules.kept_documents(df, some, ("few words", "trap")).count() == 0


def test_clean_documents_are_kept(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(rules.F.avg(rules.F.col("kept").cast("int"))).collect()
    shares = {r[0]: r[1] for r in rows}
    assert shares[1] > 0.99 and shares.get(0, 0) < 0.1


# Near duplicates in crowded buckets


@pytest.mark.parametrize("crowd", [1, 64])
def test_a_common_core_hides_no_link(spark, monkeypatch, crowd):
    """Texts around one core: most share two thirds, some pairs nine tenths; components are those of comparing all pairs."""
    from gridlume.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    pick = random.Random(11)
    word = lambda: f"u{pick.randrange(10**9)}"
    core, texts = [f"c{i}" for i in range(120)], []
    for _ in range(70):
        own = [word() for _ in range(30)]
        texts.append(core + own)
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(own))
            texts.append(core + own[:at] + [word() for _ in range(pick.randrange(1, 5))] + own[at:])
    pick.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(root)


def test_every_linked_pair_shares_a_rare_element(spark):
    """Pairs at the threshold meet in a bucket of rare elements, whatever the cells' counts."""
    from gridlume.llm import near_dedup

    pick = random.Random(4)
    texts = []
    for _ in range(40):
        base = [f"w{pick.randrange(300)}" for _ in range(100)]
        texts += [base, base[:-7] + [f"x{pick.randrange(10**6)}" for _ in range(7)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    crowd = df.selectExpr("doc_id AS doc", "doc_id AS root")
    met = {(r.a, r.b) for r in near_dedup.rare_buckets(df, crowd).alias("l").join(near_dedup.rare_buckets(df, crowd).alias("r"), "key").selectExpr("l.doc AS a", "r.doc AS b").distinct().collect()}
    sets = [set(near_dedup.shingles(" ".join(t)).tolist()) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(linked) >= 40 and all(p in met for p in linked)
