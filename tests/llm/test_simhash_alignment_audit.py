"""SimHash, token alignment and the filter audit against brute-force versions, with hard cases."""

import bisect
import collections
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash

from factrail.llm import alignment, filter_audit, simhash, token_output, tokens

DDL = "doc_id bigint, text string, lang string, source string, fp bigint, n bigint, key string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
SPECIAL = "<|endoftext|>"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    texts = [prose(30 + 7 * i, i) for i in range(10)]
    for i in range(14):
        w = prose(400, 77).split()
        w[11 * i] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [None, None, "", " \t\n", "one", "One", "one two three", "a  b\tc\nd e", prose(9000, 5), "x" * 6000, "É café naïve 😀 über", "▁ odd ▁",
              f"a {SPECIAL} b", f"{SPECIAL}{SPECIAL}x", "<s> </s> <0x41>", "nul\x00byte", "tab\there", "  two  spaces ", "ＡＢＣ", "price $5 #1 " * 60, "SHOUT " * 120]
    texts += [prose(30, 0), prose(30, 0).upper(), prose(9000, 5)]
    rows = [(i * 3, t, ["en", "de", None, ""][i % 4], "s", 1, 2, "k", "p") for i, t in enumerate(texts)]
    return [*rows, (None, prose(37, 1), "en", "s", 1, 2, "k", "p"), (None, prose(20, 900), None, None, None, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3).cache()


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    comp = {n: n for n in nodes}

    def find(n):
        while comp[n] != n:
            n = comp[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            comp[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark, docs):
    rows = [(r[0], plain_fingerprint(r[1])) for r in corpus()]
    comp = plain_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d, f in rows:
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    want = sorted((str(d), f"{f:016x}", str(least.get(comp[f]))) for d, f in rows)
    got = simhash.simhash_classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 8
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_simhash_links_of_close_fingerprints(spark, dense):
    """Chains and balls of fingerprints at distances 1 to 6, in sparse and in dense lists."""
    r = random.Random(2)
    nodes = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            nodes.add(f)
    nodes |= {r.getrandbits(64) for _ in range(60)}
    want = plain_components(sorted(nodes), lambda a, b: (a ^ b).bit_count() <= 4)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in nodes], "fp bigint"), dense).collect()
    assert all(((x.a ^ x.b) & ((1 << 64) - 1)).bit_count() <= 4 for x in links)
    edges = {frozenset((x.a & ((1 << 64) - 1), x.b & ((1 << 64) - 1))) for x in links}
    got = plain_components(sorted(nodes), lambda a, b: frozenset((a, b)) in edges)
    classes = lambda c: sorted(sorted(k for k in c if c[k] == v) for v in set(c.values()))
    assert classes(got) == classes(want)


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.default_vocabulary())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.default_pieces())


def plain_alignment(text, a, b):
    entries = tokens.byte_entries(a)
    name = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    if not text:
        return None
    x = [(i, entries[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, name(i)) for i in b.encode(text)]
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (x, y)):
        return None
    spans = []
    for side in (x, y):
        at, out = 0, []
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        spans.append(out)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    members = [([], []) for _ in cuts]
    for k, side in enumerate(spans):
        for i, _, e in side:
            members[bisect.bisect_left(cuts, e)][k].append(str(i))
    groups = ["|".join(",".join(ids) for ids in pair) for pair in members]
    links, j = [], 0
    for i, s, e in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            links.append((i, spans[1][k][0]))
            k += 1
    return len(x), len(y), groups, links


@pytest.mark.parametrize("head", [alignment.HEAD, 40])
def test_alignment_against_brute_force(spark, docs, both, head):
    plain = [(r[0], plain_alignment(r[1], *both)) for r in corpus()]
    count = collections.Counter(p for _, x in plain if x for p in x[3])
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for d, x in plain:
        if x is None:
            want.append((str(d), 0, 0, 0, 0, 0, 0, ""))
        else:
            want.append((str(d), x[0], x[1], len(x[2]), len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]),
                         hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    got = alignment.alignment(docs, head=head)
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 30 and sum(w[1] == 0 for w in want) >= 4
    assert alignment.alignment(docs.limit(0)).count() == 0


def test_plain_call_of_the_tokenizer(spark, docs, tmp_path):
    """Ids in token files are those of an untouched tokenizer, special tokens in a text included."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    path = os.path.join(str(tmp_path), "tokens")
    token_output.write_tokens(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path)
    got = {r.doc_id: r.ids for r in token_output.read_tokens(spark, path).collect()}
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in corpus() if r[0] is not None}
    assert got == want and any(50256 in v for v in want.values())


def test_filter_audit_against_brute_force(spark, docs):
    marks = [(i * 3, int(i % 3 > 0), int(i % 5 == 0), "x") for i in range(40)] + [(None, 1, 1, "x"), (6, None, None, "x"), (0, 0, 1, "x"), (99999, 1, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int, part string")
    big = 1 << 63
    least, good, toxic = {}, collections.defaultdict(bool), collections.defaultdict(bool)
    for d, t, *_ in corpus():
        least[t or ""] = min(least.get(t or "", big), big if d is None else d)
    for d, q, x, _ in marks:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= x == 1
    want = collections.defaultdict(lambda: [0] * 6)
    removed = collections.Counter()
    for d, t, lang, *_ in corpus():
        t, part = t or "", lang or ""
        w = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
            (big if d is None else d) > least[t])) if bad}
        for order in filter_audit.ORDERS:
            gone = False
            for i, f in enumerate(order):
                c = want[part, order, i + 1]
                now = f in fails and not gone
                c[2] += f in fails and gone
                gone |= f in fails
                c[0] += not gone
                c[1] += now
                c[3] += fails == {f}
                c[4] += now and good[d]
                c[5] += now and toxic[d]
                removed[part, f] += now
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == {
        k: [*map(int, v), removed[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    assert len(got) == 600 * len({k[0] for k in want}) and any(sum(v) for v in want.values())
    assert filter_audit.audit(docs.limit(0), labels).count() == 0 and filter_audit.audit(docs, labels.limit(0)).count() == len(got)


def test_overlaps_of_intervals():
    a = (np.array([0, 3, 5]), np.array([3, 5, 9]))
    b = (np.array([0, 1, 5, 8]), np.array([1, 5, 8, 9]))
    x, y = alignment.overlaps(a, b)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    order, group = alignment.coalesced(a, b)
    assert group.max() == 1 and len(order) == 7
