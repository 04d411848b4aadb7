"""The dealt operators against brute-force versions on small tables with hard cases."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from factrail.llm import exact_dedup, fingerprints, jaccard_join, langid, mixing, packing, pii, token_output, tokens, toxicity, url_filter  # noqa: E402
from factrail.llm.blocks import shingle_sets, text_blocks, word_hashes  # noqa: E402
from factrail.llm.common import components, positions  # noqa: E402

DDL = "doc_id bigint, text string, lang string, source string, digest_ string, row_ int, size_ int, key string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    passage = prose(60, 0)
    rows = []
    add = lambda t, lang="en", source="a": rows.append((len(rows), t, lang, source, "x", 1, 2, "k"))
    for i in range(12):
        add(prose(40 + 3 * i, i))
    for i in range(8):  # near copies
        w = prose(80, 50).split()
        w[7 * i + 3] = f"edit{i}"
        add(" ".join(w), source="b")
    for i in range(10):  # a passage that many share
        add(passage + " " + prose(70, 100 + i), "fr")
    for i in range(6):  # mostly the passage
        add(passage + " " + prose(6, 200 + i))
    for t in (None, "", "   \n\t", "one", "One", "one two three", "x", prose(3000, 9), "ÉCOLE é école " * 5, "😀 emoji 😀", "a" * 5000, "Straße hard space", "<|endoftext|> it's we'll 'quoted' 12,345.6 ..."):
        add(t, None, None)
    for t in (prose(40, 0).upper(), prose(43, 1), prose(43, 1)):
        add(t, "de", "c")
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def sets_of(rows, width=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()
    return out


def brute_classes(rows):
    sets = sets_of(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_jaccard_classes_match_all_pairs(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == brute_classes(pairs(docs))


def test_jaccard_hot_group_and_boundaries(spark):
    r = random.Random(5)
    rows = []
    base = prose(30, 1).split()
    for i in range(150):  # small sets, chains and near misses around the threshold
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"z{r.randrange(40)}"
        rows.append((i, " ".join(w[: r.randint(5, 30)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_classes(df).collect()}
    assert got == brute_classes(rows)


def test_jaccard_subsets_and_lists_agree(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, " ".join((prose(20, i % 9).split() + [f"q{r.randrange(9)}"])[r.randint(0, 2) :])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    for cut in (0, 10, 1000):
        monkeypatch.setattr(jaccard_join, "_boundary", lambda sets, cut=cut: cut)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_classes(df).collect()} == want


def test_representatives_keep_all_columns(docs, empty):
    want = {i for i, (_, c) in brute_classes(pairs(docs)).items() if c == i}
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert jaccard_join.representatives(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_exact_dedup(docs, empty):
    rows = pairs(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()].append(i)
    got = {r.doc_id: r for r in exact_dedup.duplicate_groups(docs).collect()}
    for h, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), h)
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(x) for x in groups.values())
    assert exact_dedup.duplicate_groups(empty).count() == 0


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "A")] * 3 + [(None, "a"), (None, "b"), (None, "b")] + [(i, "hot") for i in range(50)], "doc_id bigint, text string")
    rows = exact_dedup.duplicate_groups(df).collect()
    assert len(rows) == 56 and sum(r.kept for r in rows) == 3
    assert {(r.keep_id, r.group_size) for r in rows} == {(1, 4), (None, 2), (49, 50)}
    assert exact_dedup.without_duplicates(df).count() == 3


def brute_mix(rows, weights=mixing.WEIGHTS, top=3):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    capped = set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        level = (sum(total.values()) - sum(top * total[s] for s in capped)) / free
        more = {s for s in sources if level * weight[s] > top * total[s]}
        if more == capped:
            return size, total, {s: min(level * weight[s], top * total[s]) for s in sources}
        capped = more


def test_mixing_targets(docs, empty):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, total, target = brute_mix(rows)
    got = {r.doc_id: r for r in mixing.mix_words(docs).collect()}
    taken = collections.Counter()
    for i, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and math.isclose(r.target, target[s], rel_tol=1e-12) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = {r.doc_id: r.taken for r in mixing.mix_words(docs.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix_words(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_whole_documents(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, _, target = brute_mix(rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = collections.Counter((r.doc_id, r.source) for r in out.collect())
    largest = {s: max(size[i] for i, _, x in rows if x == s) for s in target}
    for s in target:
        assert abs(sum(n * size[i] for (i, x), n in times.items() if x == s) - target[s]) <= largest[s] / 2 + 1
    assert max(times.values()) <= 3


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return t


def test_chunks_give_the_same_ids(tokenizer):
    import pyarrow as pa

    encoder = tokens.Encoder(tokens.default_vocabulary())
    pieces = [" ", "  ", "\n", "\t", " ", " ", "\u0085", "é", "ß", "it's", "'ll", "we", "12", "3.5", "!!", "...", "😀", "漢字", "x" * 70, "<|endoftext|>", "A", "a.b", "«", "×", "'"]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(pieces) | st.text(max_size=4), max_size=12).map("".join), max_size=5))
    def run(texts):
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        got = []
        for _, offsets, data in text_blocks(pa.array(texts, pa.large_string())):
            ids, counts = encoder.block(offsets, data)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    run()


def test_token_files(spark, docs, empty, tokenizer, tmp_path):
    rows = sorted(pairs(docs))
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, files=3)
    start = 0
    got = {r.doc_id: r for r in token_output.token_digests(spark, path).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [token_output.END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_output.read_tokens(spark, path, 5, 9).collect()
    assert sorted(r.doc_id for r in some) == [5, 6, 7, 8, 9]
    assert token_output.read_lengths(spark, path).agg(F.sum("n_tokens")).first()[0] == start
    import glob

    import pyarrow.parquet as pq

    seen = []
    for f in sorted(glob.glob(path + "/part-*")):
        meta = pq.ParquetFile(f)
        seen += meta.read(columns=["doc_id"])["doc_id"].to_pylist()
        if meta.metadata.num_row_groups:
            ids = meta.metadata.row_group(0).column(2)
            assert "RLE_DICTIONARY" in ids.encodings and meta.metadata.row_group(0).column(0).has_offset_index
    assert seen == [i for i, _ in rows]
    token_output.write_tokens(empty, str(tmp_path / "none"))
    assert token_output.token_digests(spark, str(tmp_path / "none")).count() == 0


def check_plan(counts, capacity):
    bins, seen = collections.defaultdict(list), set()
    for length, a, b, first, per, place in packing.plan_bins(counts, capacity):
        for rank in range(a, b):
            assert (length, rank) not in seen
            seen.add((length, rank))
            bins[first + (rank - a) // per].append((place + (rank - a) % per * length, length))
    assert len(seen) == sum(counts.values())
    for pieces in bins.values():
        at = 0
        for place, length in sorted(pieces):
            assert place == at
            at += length
        assert at <= capacity
    free = []  # best fit decreasing, one item at a time
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= k]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= k
        else:
            free.append(capacity - k)
    assert len(bins) <= len(free)


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([7, 30, 1024]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_no_worse_than_best_fit(case):
    check_plan(dict(collections.Counter(case[1])), case[0])


def test_packing(docs, empty, tokenizer):
    capacity = 128
    pieces = packing.token_pieces(docs, capacity).cache()
    rows = packing.packed(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "ids"), capacity)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows.collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for i, t in pairs(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and (k == 0 or r.length == capacity) and r.ids == ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > capacity) == (len(by[i]) > 1)
    for parts in seq.values():
        at = 0
        for place, length in sorted(parts):
            assert place == at
            at += length
        assert at <= capacity
    assert all(len(r.ids) <= capacity for r in packing.packed_sequences(rows).collect())
    assert packing.packed_documents(empty).count() == 0


def test_language_of_held_out_texts(spark, docs, empty):
    words = {x: [f"{p}{a}{s}" for p in ps for a in "aeiou" for s in ss] for x, ps, ss in (("l1", ("th", "wh", "sh"), ("ing", "ed")), ("l2", ("sch", "pf", "gr"), ("ung", "heit")), ("l3", ("lle", "ño"), ("ción", "dad")))}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randint(3, 60))), x) for i, x in enumerate(r.choice(sorted(words)) for _ in range(240))]
    rows += [(1000, "12 34 !", "l1"), (1001, None, "l1"), (1002, "", None), (1003, " ".join(words["l1"][:20] + words["l2"][:10]), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x.doc_id: x for x in langid.languages(df).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, x in rows[:240] if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "l1" and 0.5 < got[1003].score < 0.9
    kept = langid.accepted(df.withColumn("letters_", F.lit(1)))
    assert kept.columns == [*df.columns, "letters_"] and {x.doc_id for x in kept.collect()} == set(got) - {1000, 1001, 1002}
    assert langid.languages(empty).count() == 0 and langid.accepted(empty).count() == 0
    assert langid.languages(docs).count() == docs.count()


def test_forward_backward_is_exact():
    r = np.random.default_rng(2)
    lengths = [0, 1, 5, 64, 65, 200]
    row = np.repeat(np.arange(len(lengths)), lengths)
    e, a = r.normal(size=(len(row), 3)), r.normal(size=(3, 3))
    got = langid.posteriors(e, row, len(lengths), a, np.zeros(3))
    for i, n in enumerate(lengths):
        x = np.exp(e[row == i])
        f, now = [], np.ones(3)
        for t in range(n):
            now = (now @ np.exp(a)) * x[t]
            now /= now.sum()
            f.append(now)
        b = np.ones(3)
        for t in range(n - 1, -1, -1):
            p = f[t] * b
            assert np.allclose(got[row == i][t], p / p.sum())
            b = np.exp(a) @ (x[t] * b)
            b /= b.sum()


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    bad = ["grumblefritz", "snarkle", "vexo", "idiot"]
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(VOCAB) for _ in range(r.randint(5, 50))]
        toxic = i % 6 == 0
        for _ in range(2 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    rows += [(900, None), (901, "")]
    labels += [(900, None, 1), (5000, 1, 1), (3, 0, 1)]
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [i for i in range(500) if got[i].held_out]
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score < 0.5
    none = toxicity.toxicity(df, lab.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0 and toxicity.toxicity(empty, lab).count() == 0


def test_label_model_discounts_repeated_votes():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    one = np.where(y, r.random(4000) < 0.6, r.random(4000) < 0.05)
    other = np.where(y, r.random(4000) < 0.6, r.random(4000) < 0.05)
    q, no, yes, share = toxicity.label_model(np.stack((one, one, one, other), axis=1), (y ^ (r.random(4000) < 0.01)).astype(int))
    assert share[0] < 0.45 < 0.8 < share[3] and abs(yes[3] - 0.6) < 0.05 and abs(no[3] - 0.05) < 0.03
    assert ((q > 0.5) == y).mean() > 0.97


def test_label_model_overrules_wrong_labels():
    r = np.random.default_rng(11)
    y = r.random(6000) < 0.2
    votes = np.stack([np.where(y, r.random(6000) < 0.7, r.random(6000) < 0.02) for _ in range(8)], axis=1)
    wrong = r.random(6000) < 0.04
    q, no, yes, _ = toxicity.label_model(votes, (y ^ wrong).astype(int))
    assert ((q > 0.5) == y)[wrong].mean() > 0.8 and ((q > 0.5) == y)[~wrong].mean() > 0.995
    # the label's own rates are found, not assumed
    assert abs(no[-1] - 0.04) < 0.01 and abs(yes[-1] - 0.96) < 0.015


def test_labelled_rows_by_bit_maps(spark, monkeypatch):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 10**12, -1, -32768, -40000]
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*ids, 5, 32770, 1, None]], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids] + [(99, 1)], "doc_id bigint, toxic int")
    want = sorted((f"t{i}", int(i % 3 == 0)) for i in [*ids, 1])
    assert sorted(map(tuple, toxicity._labelled(docs, known).collect())) == want
    monkeypatch.setattr(toxicity, "MAP_ROWS", 2)
    assert sorted(map(tuple, toxicity._labelled(docs, known).collect())) == want
    assert toxicity._labelled(docs, known.limit(0)).count() == 0


def test_lexicon_counts_all_labelled_rows(spark):
    """A word of toxic texts that a sample of a few rows would hardly hold still becomes an entry."""
    rare = [(i, f"{prose(12, i)} {'zorgblat' if i % 40 == 0 else 'grumfex' if i % 8 == 0 else ''}", i) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rare], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _, _ in rare], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, rows=200)
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, model).where("held_out and doc_id % 8 = 0").collect()}
    assert len(model.lexicon.entries) >= 6 and min(v for k, v in found.items() if k % 40) > 0.5


def order_minhash_order(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (-x[0], x[1]))


def test_fingerprints(docs, empty):
    order = order_minhash_order(docs)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(order)
    by_text = collections.defaultdict(set)
    for k, (i, t) in enumerate(order):
        n, following = len(t) // 3, order[(k + 1) % len(order)][1]
        e = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and 0 <= r.near_edited <= 1
        by_text[t].add(r.fingerprint)
        by_text[e].add(r.edited_fingerprint)
        assert (r.near_next == 1) >= (t == following)
    assert all(len(x) == 1 for x in by_text.values())
    own = [got[i] for i in range(1, 12)]  # texts that share nothing with the next one
    assert np.mean([r.near_edited for r in own]) > 0.1 > 0.05 > np.mean([r.near_next for r in own])
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert len(fingerprints.edited_fingerprints(docs.where("doc_id = 3")).collect()) == 1


def test_fingerprints_feel_order_and_repeats(spark):
    w = prose(300, 5).split()
    texts = {"a": w, "moved": w[150:] + w[:150], "shuffled": random.Random(1).sample(w, len(w)), "twice": w + w}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "name string, text string")
    found = {r.name: r.components for r in fingerprints.signatures(df, ["name"], "text").collect()}
    near = lambda x: sum(p == q for p, q in zip(found["a"], found[x])) / fingerprints.COMPONENTS
    assert near("a") == 1 and near("shuffled") < 0.1 and near("moved") < 0.85 and near("twice") < 0.9
    # the sets of k-mers of `a` and `moved` are nearly equal: the loss is the order


def test_fingerprints_of_short_and_unspaced_texts(spark):
    texts, kinds = {}, ("5", "16", "20", "60", "flat")
    for k in kinds:
        for i in range(20):
            w = [chr(0x4E00 + random.Random(i).randrange(300) + 37 * j) for j in range(80)] if k == "flat" else prose(int(k), 100 + i).split()
            h, by = len(w) // 2, "" if k == "flat" else " "
            forms = {"own": w, "moved": w[h:] + w[:h], "edited": [*w[:h], "zq" + w[h], *w[h + 1 :]], "other": prose(len(w), 900 + i).split()}
            texts |= {f"{k} {i} {form}": by.join(v) for form, v in forms.items()}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    found = {r.name: r.components for r in fingerprints.signatures(df, ["name"], "text").collect()}
    assert all(v is not None for c in found.values() for v in c)
    near = lambda k, form: np.mean([np.mean([p == q for p, q in zip(found[f"{k} {i} own"], found[f"{k} {i} {form}"])]) for i in range(20)])
    for k in kinds:  # a moved block keeps nearly all k-mers: what is lost beyond the edit is the order
        assert near(k, "edited") > 0.3 and 0.05 < near(k, "moved") < min(0.6, near(k, "edited")) and near(k, "other") < 0.05, k


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, empty):
    r = random.Random(8)
    bits = ["a@b.co", "_x@d.ef", "@", "a@b", "x.y+z@q-r.s.t", "1.2.3.4", ".5.6", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (555) 123-4567", "+49", "+1.2", "89 ", "😀", "é", " ", " ", "-", ",", "IBAN DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "call 555-123-4567", "12", "7"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "9 " * 30000), (1003, "b" * 60000 + "@"), (1004, "x@y.z " * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x for x in pii.personal_data(df).collect()}
    for i, t in rows:
        base = brute_pii(t or "") if i != 1003 else []
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k + ":") for x in base) for k in pii.BASE]
        assert set(base) <= set(got[i].spans.split(","))
    assert pii.personal_data(empty).count() == 0 and pii.personal_data(docs).count() == docs.count()
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789; number 123-45-6789 is long ago " + "and " * 20 + "call 555-123-4567"
    spans = {(x.kind, text[x.start : x.end]) for x in pii.personal_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect() if not x.base}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans and ("ssn", "123-45-6789") in spans and ("local_phone", "555-123-4567") in spans


def test_pii_lists_after_one_label(spark):
    far = " and" * 12
    texts = ["SSN: 123-45-6789, 987-65-4321", "Phone: 555-123-4567 / 555-987-6543 / 555-222-3333", "123-45-6789, 987-65-4321 (SSN)", f"SSN{far} 123-45-6789, 987-65-4321",
             "call 555-123-4567" + far + " 555-987-6543", "no label 123-45-6789, 987-65-4321"]
    rows = list(enumerate(texts))
    got = collections.defaultdict(list)
    for x in pii.personal_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).where("not base").collect():
        got[x.doc_id].append((x.kind, x.start, x.end))
    near = {"ssn": "ssn|social|security", "local_phone": "tel|phone|call|mobile|fax|fon|movil"}
    for i, t in rows:
        want = [(k, m.start(), m.end()) for k, p in (("ssn", r"\d{3}-\d{2}-\d{4}"), ("local_phone", r"\d{3}-\d{3}-\d{4}")) for m in re.finditer(p, t)
                if re.search(f"(?<![a-z])(?:{near[k]})", (t[max(m.start() - 48, 0) : m.start()] + " " + t[m.end() : m.end() + 48]).lower())]
        assert sorted(got[i]) == sorted(want), t
    assert [len(got[i]) for i in range(6)] == [2, 3, 2, 0, 1, 0]


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [("example.com", day(10), "block"), ("example.com", day(20), "remove"), ("example.com", day(30), "block"), ("a.example.com", day(12), "allow"), ("a.example.com/bad/", day(15), "block"),
               ("x.org", day(5), "allow"), ("x.org", day(5), "block"), (None, day(1), "block")]
    captures = [(1, "http://example.com/", day(9)), (2, "http://Example.com:80/q", day(10)), (3, "https://u@a.example.com/p", day(11)), (4, "https://a.example.com/p", day(12)), (5, "https://a.example.com/bad/x", day(16)),
                (6, "http://example.com/", day(25)), (7, "http://example.com./", day(40)), (8, "http://b.example.com/", day(19)), (9, "http://x.org", day(5)), (10, None, day(5)), (11, "no url", day(5)), (12, "http://x.org/", None), (9, "http://x.org", day(5))]
    lst, cap = spark.createDataFrame(entries, "key string, listed_on date, action string"), spark.createDataFrame(captures, "page_id bigint, url string, fetched_on date")
    got = collections.Counter((r.page_id, r.verdict, r.matched_key) for r in url_filter.judged(cap, lst).collect())
    c, a = "example.com", "a.example.com"
    assert got == collections.Counter({(1, "none", None): 1, (2, "block", c): 1, (3, "block", c): 1, (4, "allow", a): 1, (5, "block", a + "/bad/"): 1, (6, "none", None): 1, (7, "block", c): 1, (8, "block", c): 1,
                                       (9, "block", "x.org"): 2, (10, "none", None): 1, (11, "none", None): 1, (12, "none", None): 1})
    assert {r.verdict for r in url_filter.judged(cap, lst.where("false")).collect()} == {"none"}
    assert url_filter.judged(cap.where("false"), lst).count() == 0


def test_positions(spark):
    df = spark.range(100).repartition(7)
    got = {r.id: r.before_ for r in positions(df, F.desc("id"), weight=F.col("id")).collect()}
    assert got == {i: sum(range(i + 1, 100)) for i in range(100)}


def test_shingles_in_windows():
    import pyarrow as pa

    from factrail.llm import blocks

    texts = ["aa Bb  cc", "", "x" * 3000 + " " + prose(50, 1), None, " "]
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for t in texts]
    known = {}
    for size in (blocks.BLOCK_BYTES, 64):
        old, blocks.BLOCK_BYTES = blocks.BLOCK_BYTES, size
        try:
            got = collections.defaultdict(list)
            for lo, offsets, data in text_blocks(pa.array(texts)):
                row, starts, ends, h = word_hashes(offsets, data)
                for r, x in zip(row, h):
                    got[lo + r].append(int(x))
                assert shingle_sets(offsets, data, 5)[2].shape == (len(offsets) - 1,)
        finally:
            blocks.BLOCK_BYTES = old
        for i, w in enumerate(want):
            assert len(got[i]) == len(w) and all(known.setdefault(a, b) == b for a, b in zip(w, got[i]))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "mixing", "packing"]
    now = table
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = [(r.doc_id, r.text, r.source) for r in now.select("doc_id", "text", "source").collect()]
        if i < 4:
            assert out.columns == table.columns
            ids = [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert len(ids) >= 0.99 * len(before)
        elif name == "exact_dedup":
            assert sorted(ids) == sorted(max(j for j, u, _ in before if u.translate(FOLD) == t.translate(FOLD)) for t in {u.translate(FOLD) for _, u, _ in before})
        elif name == "near_duplicates":
            assert set(ids) == {j for j, (_, c) in brute_classes([x[:2] for x in before]).items() if j == c}
        elif name == "mixing":
            size, _, target = brute_mix(before)
            for s in target:
                got = sum(size[r.doc_id] for r in out.where(F.col("source").eqNullSafe(F.lit(s))).collect())
                assert abs(got - target[s]) <= max(size.values())
        else:
            rows = out.collect()
            assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(j for j, _, _ in before)
            assert sum(r.length for r in rows) > 0 and len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 1024 + 1
        now = out
