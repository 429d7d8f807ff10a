"""Operators on documents, each against a plain version on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerspark.llm import line_dedup, mixing, order_minhash, packing, simhash, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"
WORDS = "the of and with house river mountain walks slowly under bright green clouds while seven old wolves sing about winter storms".split()


def table(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source), with columns whose names clash with results."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", -1, 7.0, 3) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(rng):
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, long), (5, base), (6, base), (7, base + " end"), (8, base.upper()), (8, base.upper()), (9, "\U0001f600é字 " * 40), (10, "a" * 3000),
        (11, "x  y   z "), (12, "<|endoftext|> <s> ▁▁a"), (None, base), (None, None),
    ]


def test_token_counts(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = awkward(random.Random(1))
    got = token_counts.count_tokens(table(spark, rows), path).collect()
    expected = sorted((len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for _, t, *_ in rows)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    assert token_counts.count_tokens(table(spark, []), path).count() == 0


def test_whole_tokens_are_proved():
    path = P.path("piece_bpe_32k.model")
    assert token_counts.splits_at_blanks(path)
    whole = token_counts.whole_tokens(path)
    counter = token_counts.Counter(path, whole)
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "1", "字", "\U0001f600", "ing", ".", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert counter(texts) == [len(x) for x in counter.sp.encode(texts)]


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), epochs=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", "e", None]
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 50, 200])), rng.choices(sources, [40, 2, 1, 5, 1, 1])[0]) for i in range(400)] + [(1000, None, "z"), (7, "again", "a"), (7, "again", "a")]
    docs = table(spark, rows)
    words, decided = mixing.plan_mix(docs)
    taken = mixing.repeats(words, decided).collect()
    assert len(taken) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = plain_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in taken if r.source == source]
        assert all(r.source_size == size and math.isclose(r.target, targets[source], abs_tol=1e-6) for r in own)
        assert abs(sum(r.n * r.size for r in own) - targets[source]) <= max((r.size for r in own), default=0)
        assert all(0 <= r.n <= 3 for r in own)
    again = mixing.repeats(*mixing.plan_mix(docs)).collect()
    assert sorted((r.doc_id, r.n) for r in again) == sorted((r.doc_id, r.n) for r in taken)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.n for r in taken)
    assert mixing.mix(table(spark, [])).count() == 0


def plain_classes(rows, radius=3):
    prints = [simhash.fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, prints[i], least.get(find(i))) for i, (d, *_) in enumerate(rows))


def test_fingerprint_by_definition():
    import xxhash

    text = "The Cat sat\non the\tmat the cat SAT on the mat É"
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_classes(spark):
    rng = random.Random(2)
    base = prose(rng, 400).split()
    near = [" ".join([*base[:i], rng.choice(WORDS), *base[i + 1 :]]) for i in rng.sample(range(400), 60)]
    rows = awkward(rng) + [(100 + i, t) for i, t in enumerate(near)] + [(300 + i, prose(rng, 60)) for i in range(60)]
    got = simhash.classes(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == plain_classes(rows)
    assert simhash.classes(table(spark, [])).count() == 0


def test_simhash_links_over_crowded_cells(spark):
    """Chains of fingerprints, with cells so small that most are dealt out in blocks."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 3, dtype=np.int64)
    prints = {int(c) for c in centre}
    for c in centre:
        x = int(c)
        for _ in range(150):
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(bit)
            prints.add((x + 2**63) % 2**64 - 2**63)
    prints = sorted(prints)
    found = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), cell=4)).collect()
    root = {p: p for p in prints} | {r.u: r.v for r in found}
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert root == {p: find(p) for p in prints}


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = awkward(random.Random(3))
    docs = table(spark, rows)
    kept = simhash.near_dedup(docs).collect()
    classes = {(f, c) for none, _, f, c in plain_classes(rows) if c is not None}
    assert simhash.near_dedup(docs).columns == docs.columns
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in classes})
    assert simhash.near_dedup(table(spark, [])).count() == 0


def test_near_dedup_keeps_unlike_texts_under_one_id(spark):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(8, a), (8, b), (9, c), (8, a), (9, a), (None, d), (None, d), (None, b), (10, None), (11, "")]
    kept = simhash.near_dedup(table(spark, rows)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept), key=str) == sorted([(False, 8, a), (False, 8, b), (False, 9, c), (True, 0, d), (False, 10, None)], key=str)


def test_order_minhash(spark):
    rows = awkward(random.Random(6))
    got = order_minhash.fingerprint_with_next(table(spark, rows)).collect()
    ordered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(t or "")
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars in {len(t) for t in texts[r.doc_id]}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    unique = [(d, ts[0]) for d, ts in sorted(((d, ts) for d, ts in texts.items() if d is not None and d < 8))]
    for (d, t), (_, following) in zip(unique, unique[1:]):
        r = next(x for x in ordered if x.doc_id == d)
        other = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert r.fingerprint == order_minhash.as_text(order_minhash.signature(t))
        assert r.near_edited == order_minhash.likeness(order_minhash.signature(t), order_minhash.signature(other))
    assert next(x for x in ordered if x.doc_id == 5).near_next == 1.0
    assert order_minhash.fingerprint_with_next(table(spark, [])).count() == 0
    alone = order_minhash.fingerprint_with_next(table(spark, [(3, "abcdef")])).first()
    assert (alone.near_next, alone.edited_sha256) == (1.0, hashlib.sha256(b"abcabc").hexdigest())


def test_order_minhash_sees_order():
    rng = random.Random(8)
    words = [prose(rng, 6) for _ in range(80)]
    text, shuffled = " ".join(words), " ".join(sorted(words))
    edited = " ".join(words[:40] + ["stone"] + words[40:])
    own = order_minhash.signature(text)
    assert order_minhash.likeness(own, order_minhash.signature(edited)) > order_minhash.likeness(own, order_minhash.signature(shuffled))


@pytest.mark.parametrize("kmers", [1000, 1023, 2047, 4090])
def test_order_minhash_of_a_longer_text(kmers):
    """A few characters more don't change the keys of the k-mers before them, on either side of a power of two."""
    rng = random.Random(kmers)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(kmers + order_minhash.K - 1))
    for more in (2, 20):
        longer = text + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(more))
        assert order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(longer)) > 0.85


def plain_lines(text):
    out, start = [], 0
    ends = [c == "\n" or (c == " " and i > 0 and text[i - 1] in ".,!?;:\u2026") for i, c in enumerate(text)]
    for i in range(line_dedup.LEAST, len(text)):
        if ends[i] and not any(ends[i - line_dedup.LEAST : i]):
            out.append(text[start : i + 1])
            start = i + 1
    return [*out, text[start:]]


def plain_line_dedup(rows):
    docs = sorted({(d is not None, d or 0, t) for d, t, *_ in rows if t}, key=lambda x: x[:2])
    first, removed, lines = {}, {}, {}
    for has, d, text in docs:
        key = (has, d, text)
        own = lines[key] = plain_lines(text)
        content = [x[:-1] for x in own[:-1]] + [own[-1]]
        weight = [len(x) + 1 for x in content]
        grams = set()
        for i in range(len(own)):
            for span in ([(i, j) for j in range(i, len(own))], [(j, i) for j in range(i, -1, -1)]):
                hit = next(((a, b) for a, b in span if sum(weight[a : b + 1]) >= line_dedup.RUN), None)
                if hit:
                    grams.add(hit)
        for a, b in sorted(grams):
            name = tuple(content[a : b + 1])
            where = first.setdefault(name, (key, a))
            if where != (key, a):
                since = max(a, where[1] + b - a + 1) if where[0] == key else a
                removed.setdefault(key, set()).update(range(since, b + 1))
    return {k: ("".join(x for i, x in enumerate(own) if i not in removed.get(k, ())), len(removed.get(k, ()))) for k, own in lines.items()}


def test_line_dedup(spark):
    rng = random.Random(9)
    sentence = lambda n: (prose(rng, n) + ".").capitalize()
    passage = " ".join(sentence(9) for _ in range(7))
    rows = [(i, "\n".join(sentence(rng.randrange(1, 20)) for _ in range(8))) for i in range(40)]
    rows += [(100 + i, sentence(14) + " " + passage) for i in range(20)] + [(200 + i, passage + "\n" + sentence(12)) for i in range(5)]
    rows += [(300, (sentence(10) + " ") * 40), (301, rows[0][1]), (0, rows[0][1]), (302, None), (303, ""), (None, passage), (304, "x. " * 200), (305, "Wow!! No!! " * 60)]
    verse = "\n".join(prose(rng, 3) for _ in range(40))
    short = ". ".join(prose(rng, 2) for _ in range(40))
    rows += [(400, prose(rng, 30) + "\n" + verse), (401, verse + "\n" + prose(rng, 9)), (402, short), (403, sentence(9) + " " + short), (404, "v1.2.3 costs 0.5 or 1.7; " * 30), (405, "a\nb\nc\n" * 90)]
    expected = plain_line_dedup(rows)
    got = line_dedup.line_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {(d, t) for d, t, *_ in rows}
    by_id = {}
    for d, t in texts:
        by_id.setdefault(d, []).append(t)
    for r in got:
        options = [expected[d is not None, d or 0, t] for d, t in texts if t and d == r.doc_id] or [(by_id[r.doc_id][0], 0)]
        assert (r.text, r.n_removed) in options
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert len(next(r.text for r in got if r.doc_id == 401)) < 60, "short lines make grams too"
    assert len(next(r.text for r in got if r.doc_id == 403)) < 120, "so do short sentences"
    last_words = passage.split(". ")[-1]
    assert sum(last_words in (r.text or "") for r in got) == 1, "a passage stays in its first document alone"
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = awkward(random.Random(10)) + [(500 + i, prose(random.Random(i), 30 * i)) for i in range(40)]
    got = packing.packed_documents(table(spark, rows)).collect()
    ids = sorted((d or -1, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in rows)
    starts = sorted((r.doc_id or -1, r.doc_tokens) for r in got if r.start == 0)
    assert starts == sorted((d, len(x)) for d, x in ids)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id or -1, []).append(r)
    for d, x in ids:
        if sum(e[0] == d for e in ids) > 1:
            continue
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(x)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    whole = packing.pack(table(spark, rows), P.path("byte_bpe_50k.json")).collect()
    assert sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in whole) == sorted(r.ids_crc32 for r in got)
    assert packing.packed_documents(table(spark, [])).count() == 0


def test_fast_ids_are_the_slow_ones():
    fast = packing.encoder.__wrapped__(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    slow = packing.encoder.__wrapped__(P.path("byte_bpe_50k.json"))
    for start in range(0, 0x110000, 97):
        if not 0xD800 <= start < 0xE000:
            text = f"a{chr(start)}1 {chr(start)}.{chr(start)}"
            assert (fast(text) == slow(text)).all(), hex(start)
    assert (fast(" " * 1_200_000) == slow(" " * 1_200_000)).all()


def test_bm25_against_the_formula():
    rng = random.Random(11)
    docs = [np.array([rng.randrange(60) for _ in range(rng.randrange(1, 50))], np.uint32) for _ in range(40)]
    index = packing.Index(docs)
    mean = sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in range(60)}

    def weight(t, d):
        tf = int((docs[d] == t).sum())
        idf = math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] > 1 else 0
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))

    for seed in range(40):
        near = index.neighbours(seed, terms=1000)
        score = {d: sum(weight(t, d) for t in set(docs[seed].tolist()) if (docs[d] == t).any()) for d in range(40)}
        best = sorted((d for d in score if score[d] > 0), key=lambda d: -score[d])
        assert set(near.tolist()) == set(best)
        assert all(score[a] >= score[b] - 1e-3 for a, b in zip(near, near[1:]))


def test_bm25_of_all_terms_as_packed():
    """As the packer asks for them, without a number of terms: light terms count and find documents too."""
    rng = random.Random(13)
    docs = [np.array([t for t in range(400) if rng.random() < (0.05 + 0.9 * (t % 4 == 0))], np.uint32) for _ in range(60)]
    docs += [np.array([2000 + i, 2000 + i, *range(20)], np.uint32) for i in range(20)] + [np.array([2000 + i for i in range(20) for _ in range(9)] + [2100], np.uint32), np.array([2100], np.uint32)]
    index = packing.Index(docs)
    mean = sum(map(len, docs)) / len(docs)
    counts = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    df = {t: sum(t in c for c in counts) for t in {t for c in counts for t in c}}
    for seed in range(len(docs)):
        shared = [[t for t in counts[seed] if t in c and df[t] > 1] for c in counts]
        score = [sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (packing.K1 + 1) / (c[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in own) for own, c, d in zip(shared, counts, docs)]
        near = index.neighbours(seed).tolist()
        assert set(near) == {i for i, s in enumerate(score) if s > 0}
        assert all(score[a] >= score[b] - 1e-3 for a, b in zip(near, near[1:]))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    insults = ["idiot", "moron", "stupid"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for insult in rng.sample(insults, 2):
                words.insert(rng.randrange(len(words)), insult)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    hidden = ["you 1d10t go", "what a m0r0n here", "so stuuuupid really", "an i d i o t indeed", "m.o.r.o.n walks", "the st*u*p*i*d wolves"]
    rows += [(2000 + i, prose(rng, 20) + " " + h + " " + prose(rng, 20)) for i, h in enumerate(hidden)]
    rows += [(3000, None), (3001, ""), (3002, "river 2024 b2b under w0lves hmmm!!!"), (3003, prose(rng, 20_000)), (3, rows[3][1])]
    return rows, labels, len(hidden)


def test_toxicity(spark, labelled):
    rows, labels, hidden = labelled
    marked = spark.createDataFrame([*labels, (3000, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, rows), marked).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert sum(got[2000 + i].predicted for i in range(hidden)) == hidden
    assert [got[i].predicted for i in (3000, 3001, 3002, 3003)] == [0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(table(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert [r.predicted for r in got] == [0, 0]
    assert toxicity.score_toxicity(table(spark, []), none).count() == 0


def test_restore():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for word in ["stupid", "idiot", *WORDS] * 20:
        s = toxicity.symbols(f"  {word} ")
        np.add.at(counts, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    model = toxicity.CharacterModel(counts)
    assert toxicity.restore("such $tup1d i d i o t\nwalks", model) == "such stupid idiot\nwalks"
    assert toxicity.restore(None, model) == ""


def test_spaced_runs_and_long_tokens_give_their_words():
    counts = np.zeros(toxicity.SYMBOLS**3)
    for text in ["such a stupid idiot", "you idiot", "a moron", *WORDS] * 20:
        s = toxicity.symbols(f"  {text} ")
        np.add.at(counts, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    read = toxicity.Reader(toxicity.CharacterModel(counts))
    for text, word in [("such a m o r o n", "moron"), ("y o u i d i o t", "idiot"), ("y 0 u 1 d 1 0 t", "idiot"), ("stup" + "i" * 70 + "d", "stupid"), ("m" + "." * 80 + "o.r.o.n", "moron")]:
        assert f"w:{word}" in read(text), text
    long = "y o u i d i o t " * 40
    assert "w:idiot" in read(long)


def test_decoding_against_all_readings():
    """Viterbi's best word is the best of all readings of short lattices, spelt out one by one."""
    counts = np.zeros(toxicity.SYMBOLS**3)
    for word in ["stupid", "idiot", "moron", *WORDS] * 20:
        s = toxicity.symbols(f"  {word} ")
        np.add.at(counts, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    model = toxicity.CharacterModel(counts)

    def chance(letters):
        s = [0, 0, *(int(toxicity.symbols(c)[0]) for c in letters), 0]
        return sum(model(a, b, c) for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("1d10t", "m0r0n", "stuuupid", "st*u*p1d", "w1nt3r", "m.o.r.0.n", "b2b", "h0u5e"):
        readings = [("", 0.0)]
        for place in toxicity.lattice(token):
            readings = [(word + letters, score + channel) for word, score in readings for letters, channel in place]
        best = max((score + chance(word), word) for word, score in readings if word)
        assert toxicity.decode(token, model)[0] == best[1], token


def test_logistic_against_gradient():
    """At the fitted weights the penalised likelihood is flat."""
    rng = np.random.default_rng(3)
    x = rng.random((200, 5)) < 0.4
    y = (rng.random(200) < 1 / (1 + np.exp(1 - 2 * x[:, 0] - x[:, 1]))).astype(float)
    doc, feature = np.nonzero(x)
    weight, bias = toxicity.logistic(doc, feature, y, 5, penalty=0.5, steps=4000)
    error = 1 / (1 + np.exp(-(x @ weight + bias))) - y
    assert np.abs(x.T @ error + 0.5 * weight).max() < 0.05
    assert abs(error.sum()) < 0.05
