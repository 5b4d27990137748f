"""The operators on documents against brute force, on odd rows, and on no rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlume.llm import fingerprints, mixing, near_dedup, packing, quality, token_counts, toxicity
from gridlume.llm.queries import QUERIES, tokenizer

from .conftest import TEXTS


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def check_packing(rows, texts, word_bpe):
    """rows against the tokenizer itself: each id in one piece, gapless sequences."""
    ids = {k: np.array([*word_bpe.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts}
    pieces = defaultdict(Counter)
    for r in rows:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole)
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id][r.start, r.length] += 1
    copies = Counter(k for k, _ in texts)
    for k, got in pieces.items():
        at = 0
        for (start, length), n in sorted(got.items()):
            assert (start, n) == (at, copies[k])
            at += length
        assert at == len(ids[k])
    assert set(pieces) == set(copies)
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return placed


def test_packing_of_odd_rows(odd, none, word_bpe):
    check_packing(packing.pack_documents(odd, tokenizer("word_bpe_49k.json")).collect(), [r[:2] for r in TEXTS], word_bpe)
    assert packing.pack_documents(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_of_the_table(spark, sf, word_bpe):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    placed = check_packing(QUERIES["op1_packing"](spark, sf).collect(), texts, word_bpe)
    used = [sum(n for _, n in spans) for spans in placed.values()]
    assert sum(4096 - u for u in used) < 0.08 * 4096 * len(used)


def first_fit_decreasing(demand, capacity):
    left, bins = dict(demand), 0
    while any(left.values()):
        room, used = capacity, Counter()
        for k in sorted(left, reverse=True):
            used[k] = min(left[k], room // k)
            room -= used[k] * k
        times = min(left[k] // n for k, n in used.items() if n)
        for k, n in used.items():
            left[k] -= n * times
        bins += times
    return bins


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(1)
    demand = {int(k): int(n) for k, n in zip(rng.choice(256, 60, replace=False) + 1, rng.integers(1, 5000, 60), strict=True)}
    patterns = packing.cutting_stock(demand, 256)
    made = Counter()
    for pattern, times in patterns:
        assert sum(k * n for k, n in pattern.items()) <= 256
        for k, n in pattern.items():
            made[k] += n * times
    assert dict(made) == demand
    bins, large = sum(t for _, t in patterns), sum(n for k, n in demand.items() if k > 128)
    assert max(large, sum(k * n for k, n in demand.items()) / 256) <= bins <= first_fit_decreasing(demand, 256)
    assert packing.cutting_stock({}, 256) == []


def test_cutting_stock_of_every_length_class(spark):
    """All 256 classes, in a process that has started a JVM: the inverse must not wait for threads lost in that fork."""
    rng = np.random.default_rng(2)
    demand = {k: int(n) for k, n in enumerate(rng.integers(1, 3000, 256), 1)}
    patterns = packing.cutting_stock(demand, 256)
    made = Counter()
    for pattern, times in patterns:
        for k, n in pattern.items():
            made[k] += n * times
    assert dict(made) == demand
    floor = sum(k * n for k, n in demand.items()) / 256
    assert sum(t for _, t in patterns) <= 1.01 * floor + 1
    square = rng.integers(0, 3, (180, 180)) + np.diag(np.arange(180.0) + 1)
    assert np.allclose(packing.inverted(square) @ square, np.eye(180), atol=1e-6)


def test_mixing_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(TEXTS)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _, _ in TEXTS}
    assert all(r["size"] == words[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    assert abs(sum({r.target for r in rows}) - sum(words[k] for k, *_ in TEXTS)) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns and copies.count() > 0
    assert mixing.mixed_documents(none).count() == 0


def test_targets_are_met_by_source(spark, sf):
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def brute_components(texts):
    def shingle_set(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {k: shingle_set(t) for k, t in texts}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k in sorted(sets):
        shared = Counter(j for s in sets[k] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(sets[k]) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_dedup_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    want = brute_components([(k, t) for k, t, _, _ in TEXTS if k is not None])
    assert len(rows) == len(TEXTS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_of_a_chain_and_a_hub(spark):
    """Copies of one text with few or many changed words, and a chain in which only neighbours are alike."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.choice(150, k % 6, replace=False):
            w[at] = f"x{k}_{at}"
        texts.append((1000 - k, " ".join(w)))
    chain = [f"c{i}" for i in range(220)]
    texts += [(2000 + i, " ".join(chain[4 * i : 4 * i + 120])) for i in range(25)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("part,members", [(2, 3)])
def test_near_dedup_in_small_parts(spark, monkeypatch, part, members):
    """One hub with many pairs, a bucket of many groups that share a passage, and hot copies: dealt in parts, the same."""
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(300)]
    texts = [(k, " ".join([*passage, *(f"q{k % 12}_{i}" for i in range(45 + k % 3))])) for k in range(1, 37)]
    texts += [(100 + k, " ".join(w if rng.random() > 0.004 else f"z{k}" for w in passage)) for k in range(20)]
    texts += [(200 + k, "one and the same text of some words") for k in range(30)] + [(300 + k, "") for k in range(10)]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_a_document_with_two_texts_is_one_node(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, "other words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_near_dedup_of_the_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_near_dedup"](spark, sf).collect()}
    assert got == brute_components(texts)


def test_superminhash_by_rounds_is_the_element_loop():
    """The reference form: one element after another, with its own permutation, no early stop."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 40, 700)]
    got = near_dedup.signatures(sets, 32)
    for s, row in zip(sets, got, strict=True):
        want = np.full(32, 0xFFFFFFFF, np.uint32)
        for e in s:
            order = list(range(32))
            for j in range(32):
                r = int(near_dedup.mixed(np.array([int(e) + (j + 1) * int(near_dedup._odd[0]) & 2**64 - 1], np.uint64))[0])
                k = j + ((r >> 32) * (32 - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], (j << 24) | (r & 0xFFFFFF))
        assert (want == row).all()


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[200:])
    s = near_dedup.signatures([a, b], 240)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1


def test_token_counts_are_the_library_s(odd, none, byte_bpe):
    got = token_counts.count_tokens(odd, tokenizer("byte_bpe_50k.json")).collect()
    want = {k: (len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for k, t, _, _ in TEXTS}
    assert len(got) == len(TEXTS)
    assert all((r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_transducer_on_random_text(byte_bpe):
    rng = np.random.default_rng(7)
    machine = token_counts.transducer(tokenizer("byte_bpe_50k.json"))
    letters = list("aeint shrdlu'’ \n\t\r\x0b\x1c\x85\u00a0\u2003\u3000.,!?0123٣½ßéÉ漢😀'sT'd") + ["'s", "  ", "<|endoftext|>", "the", "ing"]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert machine.document(text) == len(byte_bpe.encode(text, add_special_tokens=False).ids), repr(text)


def test_states_are_bounded_inside_a_piece(byte_bpe, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    machine = token_counts.Transducer(tokenizer("byte_bpe_50k.json"))
    text = "".join(np.random.default_rng(8).choice(list("abcdefghinorst"), 5000))
    assert machine.document(text) == len(byte_bpe.encode(text, add_special_tokens=False).ids)
    assert len(machine.states) <= 52 and not machine.new


def test_chunk_maps_compose(byte_bpe, monkeypatch):
    machine = token_counts.transducer(tokenizer("byte_bpe_50k.json"))
    text = "It's  a small,\n\n odd text — don't you think? aaaaaaaaaaaaaaaaaaaaaaaaa" * 4
    want = len(byte_bpe.encode(text, add_special_tokens=False).ids)
    for size in (1, 2, 3, 7, 16, 50):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert machine.document(text) == want


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.fingerprint_documents(odd).collect()
    order = sorted(((k, t or "") for k, t, _, _ in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        want.append((k, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_fingerprint_is_a_multiset_hash():
    add = lambda *v: tuple(sum(x[i].astype(object) for x in v) for i in (0, 1))
    same = lambda a, b: all(((np.asarray(x, object) - np.asarray(y, object)) % m == 0).all() for x, y, m in zip(a, b, (2**64, 2**32), strict=True))
    p, q = "first line of words", "second line, other words"
    assert fingerprints.shown(fingerprints.vector(f"{p}\n{q}")) == fingerprints.shown(fingerprints.vector(f"{q}\n{p}"))
    assert same(add(fingerprints.vector(p), fingerprints.vector(q)), fingerprints.vector(f"{p}\n{q}"))
    assert not same(fingerprints.vector(f"{p}\n{p}"), fingerprints.vector(p))


def test_paragraphs_are_inserted_and_deleted():
    lines = ["first line of words", "", "second line, other words", "ünï"]
    whole = lambda x: fingerprints.shown(fingerprints.vector("\n".join(x)))
    for at, line in enumerate(lines):
        rest = lines[:at] + lines[at + 1 :]
        assert fingerprints.insert(whole(rest), line) == whole(lines) and fingerprints.delete(whole(lines), line) == whole(rest)
    with pytest.raises(ValueError, match="one line"):
        fingerprints.insert(whole(lines), "a\nb")


def test_likeness_follows_the_exact_one():
    """Near the cosine-like share of common three-word runs, counted exactly."""
    rng = np.random.default_rng(14)
    for share in (0.0, 0.3, 0.7, 1.0):
        a = [f"w{i}" for i in rng.integers(0, 10**6, 600)]
        b = a[: int(600 * share)] + [f"v{i}" for i in rng.integers(0, 10**6, 600 - int(600 * share))]
        x, y = (Counter(zip(["^", "^", *t], ["^", *t], t, strict=False)) for t in (a, b))
        exact = 1 - sum((x[k] - y[k]) ** 2 for k in x | y) / (sum(v * v for v in x.values()) + sum(v * v for v in y.values()))
        assert abs(fingerprints.likeness(*(fingerprints.vector(" ".join(t)) for t in (a, b))) - exact) < 0.2


def test_ranges_are_of_like_size_for_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 10)
    ids = [*range(300), 10**15, 10**15 + 1, None, None]
    rows = fingerprints.in_ranges(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).where("borrowed = 0").collect()
    sizes = Counter(r.range for r in rows)
    assert len(rows) == len(ids) and len(sizes) > 20 and max(sizes.values()) <= 40
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert [r.range for r in order] == sorted(r.range for r in rows)


def test_next_document_over_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 7)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    want = {}
    for i, k in enumerate(ids):
        n = len(texts[k]) // 3
        want[k] = hashlib.sha256((texts[k][: len(texts[k]) - n] + texts[ids[(i + 1) % len(ids)]][:n]).encode()).hexdigest()
    got = QUERIES["op6_fingerprints"](spark, sf).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    edited, following = (np.mean([getattr(r, c) for r in got]) for c in ("near_edited", "near_next"))
    assert edited > 0.55 and following < 0.15


def figures(rows, labels):
    """Recall and precision of label 1, recall of label 0 and AUC on the held-out labelled rows."""
    known = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    score, said, truth = (np.array(x) for x in zip(*known, strict=True))
    above = (score[truth == 1][:, None] > score[truth == 0]).mean() + 0.5 * (score[truth == 1][:, None] == score[truth == 0]).mean()
    return said[truth == 1].mean(), truth[said == 1].mean(), 1 - said[truth == 0].mean(), above


#: Least recall and precision of label 1, recall of label 0 and AUC. A document labelled toxic can have no toxic word, so that its label can't be seen.
BARS = {"op4_toxicity": (0.85, 0.85, 0.98, 0.95), "op10_quality": (0.98, 0.98, 0.97, 0.99)}


@pytest.mark.parametrize("name,label,folds,fold", [("op4_toxicity", "toxic", 5, 0), ("op10_quality", "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, name, label, folds, fold):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, sf).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(got >= bar for got, bar in zip(figures(rows, labels), BARS[name], strict=True)), figures(rows, labels)


def naive_risk(w, positive, unlabelled, prior):
    margin = lambda d: w[-1] + sum(w[i] for i in d)
    loss = lambda z: np.log1p(np.exp(-z))
    gain = prior * np.mean([loss(margin(d)) for d in positive])
    return gain, np.mean([loss(-margin(d)) for d in unlabelled]) - prior * np.mean([loss(-margin(d)) for d in positive])


def test_risk_and_its_gradients_are_the_naive_ones():
    rng = np.random.default_rng(9)
    positive, unlabelled = ([np.flatnonzero(rng.random(6) < 0.4) for _ in range(n)] for n in (9, 14))
    w = rng.normal(size=7)
    sides = toxicity.Sample(positive, 6), toxicity.Sample(unlabelled, 6)
    gain, against, up, down = toxicity.risk(w, *sides, 0.2)
    assert np.allclose((gain, against), naive_risk(w, positive, unlabelled, 0.2))
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        high, low = (naive_risk(w + s, positive, unlabelled, 0.2) for s in (step, -step))
        assert np.allclose([up[i], down[i]], [(h - l) / 2e-5 for h, l in zip(high, low, strict=True)], atol=1e-6)


def test_cut_has_the_least_risk():
    rng = np.random.default_rng(10)
    fp, fu = rng.normal(1, 1, 40), np.concatenate([rng.normal(1, 1, 10), rng.normal(-1, 1, 90)])
    total = lambda t: 0.1 * (fp < t).mean() + max(0, (fu >= t).mean() - 0.1 * (fp >= t).mean())
    assert total(toxicity.least_risk_cut(fp, fu, 0.1)) <= min(map(total, np.linspace(-4, 5, 4000))) + 1e-9
    assert -1 < toxicity.least_risk_cut(np.array([3.0, 4.0]), np.array([-3.0, 3.5]), 0.5) < 1


def test_votes_are_the_naive_ones():
    """Every similarity by itself, sorted, ties with the last place included."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(60)] + ["", None, "Same text. here"]
    counts = [quality.terms(t) for t in texts]
    labels = rng.integers(0, 2, len(texts)).astype(float)
    model = quality.Model([np.stack([np.flatnonzero(c), c[c > 0]]).astype("<u4") for c in counts], labels)
    asked = [*texts[:10], "w1 w2 w3 other", "", None]
    for text, got in zip(asked, model.vote(asked), strict=True):
        v = model.unit(model.weighted(quality.terms(text)[None]) @ model.basis)[0]
        near = model.vectors @ v
        last = np.sort(near)[-quality.NEIGHBOURS]
        votes = [(max(float(s), 0) ** 4, y) for s, y in zip(near, labels, strict=True) if s >= last]
        total = sum(s for s, _ in votes)
        assert abs(got - (sum(s * y for s, y in votes) / total if total > 1e-9 else labels.mean())) < 1e-4


def test_terms_hold_words():
    same_shape = quality.terms("the cat sat on the mat near a river today"), quality.terms("an elk ran up an oak from a forest again")
    assert (same_shape[0][: quality.SHAPES] == same_shape[1][: quality.SHAPES]).all() and (same_shape[0] != same_shape[1]).any()
    assert (quality.terms("Near the RIVER")[quality.SHAPES :] == quality.terms("near river, the")[quality.SHAPES :]).all()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_of_repeated_labels_one_holds(spark, odd, module, label):
    """Toxic holds over clean, low quality over high, whatever the order of the rows."""
    rows = [(i, i % 2, i % 2) for i in range(1, 12)]
    held = 1 if label == "toxic" else 0
    extra = [(i, held, held) for i in range(1, 6)]
    scores = [sorted(map(str, module.classify(odd, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (rows + extra, extra + rows, [(i, held if i < 6 else q, held if i < 6 else q) for i, q, _ in rows])]
    assert scores[0] == scores[1] == scores[2]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, none, module, label):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], schema)
    assert module.classify(odd, labels).count() == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in module.classify(odd, labels).collect())
    assert module.classify(odd, labels.limit(0)).count() == len(TEXTS)
    assert module.classify(none, labels).count() == 0


def test_labels_of_the_held_out_fold_dont_matter(spark, odd):
    """Changed labels of held-out rows leave the scores as they are."""
    rows = [(i, (i // 2) % 2, (i // 3) % 2) for i in range(1, 12)]
    held = lambda i, folds, fold: zlib.crc32(str(i).encode()) % folds == fold
    for module, at, folds, fold in ((toxicity, 2, 5, 0), (quality, 1, 3, 1)):
        turned = [tuple(1 - v if j == at and held(r[0], folds, fold) else v for j, v in enumerate(r)) for r in rows]
        a, b = (module.classify(odd, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).select("score").collect() for x in (rows, turned))
        assert sorted(map(str, a)) == sorted(map(str, b))
