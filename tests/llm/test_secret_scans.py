import math
import random
import re
import string

from ledgerspark.llm import secret_scans as ss

DOCS = "doc_id long, text string, kind string, start int"


def spans(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in ss.scan(df).collect()}


def expected(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_fixed_kinds_match_a_plain_scan(spark):
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "😀", "é", "\x01", "\x02", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "secret:token:abcdefgh", "\x01password=abcdefg\x02", "a" * 100_000 + " token=abcdefg1"]
    got = spans(spark, list(enumerate(texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "random"] == expected(t), t


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(5)
    alphabet = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(30)]
    words = [
        "internationalization_of_release_candidate_2024", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcabcabcabcabcabcabcabcabc123", "12345678901234567890123456789012345678901234",
        "src/main/resources/configuration/default-settings-v2", "Donaudampfschifffahrtsgesellschaft1", "=" * 40 + "1", "version-one-two-three-four-five-6",
    ]
    got = spans(spark, [*enumerate(f"see {k} there" for k in keys), *((100 + i, f"see {w} there") for i, w in enumerate(words))])
    assert sum(bool(got[i]) for i in range(30)) >= 27
    assert [w for i, w in enumerate(words) if any(s[0] == "random" for s in got[100 + i])] == []
    assert all(got[i] in ([], [("random", 4, 52)]) for i in range(30))


def test_strings_of_letters_alone_are_tested(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice(string.ascii_letters) for _ in range(40)) for _ in range(30)]
    words = ["Donaudampfschifffahrtsgesellschaft", "internationalizationOfReleaseCandidates", "src/main/resources/configuration/defaults", "pneumonoultramicroscopicsilicovolcanoconiosis", "a" * 40, "=" * 30, "-" * 50, "_" * 25]
    got = spans(spark, [*enumerate(f"see {k} there" for k in keys), *((100 + i, f"see {w} there") for i, w in enumerate(words))])
    assert sum(got[i] == [("random", 4, 44)] for i in range(30)) >= 27
    assert [w for i, w in enumerate(words) if any(s[0] == "random" for s in got[100 + i])] == []


def normal(z):
    return 1 / (1 + math.exp(max(-600, min(600, -1.5976 * z - 0.07056 * z**3))))


def joined(tails):
    x = -sum(math.log(max(1e-30, t)) for t in tails)
    return math.exp(-x) * sum(x**j / math.factorial(j) for j in range(len(tails)))


def plain_p(match):
    """The p-value of "this is text", character by character."""
    name, _, alphabet = next(e for e in ss.ENCODINGS if re.search(e[1], match))
    s = re.sub("=+", "", match.translate(str.maketrans("-_", "+/")))
    n, k = len(s), len(alphabet)
    chi = sum((s.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    apart = n * max(k * ss.COINCIDENCE - 1, 0.3)
    tails = [normal((chi - (k - 1 + apart)) / math.sqrt(2 * (k - 1) + 4 * apart))]
    pairs = list(zip(s, s[1:]))
    if name in ss.KIND_CHANGES:
        rate, kind = ss.KIND_CHANGES[name], lambda c: 0 if c in ss.LOWER else 1 if c in ss.UPPER else 2 if c in ss.DIGIT else 3
        changed = sum(kind(a) != kind(b) for a, b in pairs)
        tails.append(normal(-(changed - 0.5 - rate * len(pairs)) / math.sqrt(len(pairs) * rate * (1 - rate))))
    letters = [(a, b) for a, b in pairs if a.isalpha() and b.isalpha()]
    if name not in ss.NARROW and letters:
        rate, changed = ss.VOWEL_CHANGES, sum((a.lower() in "aeiouy") != (b.lower() in "aeiouy") for a, b in letters)
        tails.append(normal((changed + 0.5 - rate * len(letters)) / math.sqrt(len(letters) * rate * (1 - rate))))
    bits = [2 * alphabet.index(c) >= k for c in s]
    ones, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:]))
    expected = 2 * ones * (n - ones) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z = (runs - expected) / math.sqrt(spread) if spread > 0 else 99
    v = [alphabet.index(c) - (k - 1) / 2 for c in s]
    serial = sum(a * b for a, b in zip(v, v[1:])) / sum(x * x for x in v) * math.sqrt(n)
    agrees = joined([max(1e-12, 2 * normal(-abs(x))) for x in (z, serial)])
    return max(joined(tails), 1e-30) if agrees >= ss.UNIFORM else 1.0


def test_p_values_against_plain_statistics(spark):
    rng = random.Random(11)
    strings = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 80))) for _, _, a in ss.ENCODINGS for _ in range(25)]
    strings += ["internationalizationOfReleaseCandidates", "src/main/resources/configuration-v2", "DE89370400440532013000", "aHR0cHM6Ly9leGFtcGxlLmNvbS9wYXRo==", "-" * 30, "abababababababababababab"]
    got = {r.match: r.p for r in ss.battery(spark.createDataFrame([(x,) for x in strings], "match string")).collect()}
    for x in strings:
        assert math.isclose(got[x], plain_p(x), rel_tol=1e-6, abs_tol=1e-30), x


def test_recall_by_encoding():
    """Of random strings, the share that could be found at all; text of the same alphabet hardly ever is."""
    rng = random.Random(12)
    least = {("hexupper", 32): 0.85, ("hexupper", 64): 0.95, ("base32", 40): 0.8, ("base36", 32): 0.75, ("base36upper", 40): 0.85, ("lower", 64): 0.85, ("upper", 64): 0.85, ("base64", 24): 0.85, ("base64", 40): 0.97}
    for name, _, alphabet in ss.ENCODINGS:
        for n in (20, 24, 32, 40, 64):
            share = sum(plain_p("".join(rng.choice(alphabet) for _ in range(n))) <= ss.RATE for _ in range(300)) / 300
            assert share >= least.get((name, n), 0.0), (name, n, share)
    words = "under the bright green mountain seven old wolves sing about winter storms while clouds walk slowly over house and river".split()
    for style in ("".join, "-".join, "_".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper()):
        strings = [style([rng.choice(words) for _ in range(rng.randrange(5, 10))]) for _ in range(300)]
        assert sum(plain_p(x) <= ss.RATE for x in strings) <= 3


def test_discoveries_are_those_of_benjamini_and_hochberg(spark):
    rng = random.Random(13)
    rows = [("base64", 5, 10 ** -rng.uniform(0, 2.5)) for _ in range(300)] + [("base64", 5, 10 ** -rng.uniform(3, 9)) for _ in range(40)] + [("hex", 4, 10 ** -rng.uniform(0, 5)) for _ in range(50)] + [("digits", 4, 1.0)] * 20
    rate = 0.05
    got = {(r.encoding, r.length_class): r.least_cell for r in ss.discoveries(spark.createDataFrame(rows, "encoding string, length_class int, p double"), rate).collect()}
    for stratum in {r[:2] for r in rows}:
        # p-values rounded up to the upper edge of their cells, as documented
        p = sorted(10 ** (-math.floor(-math.log10(x) * 10) / 10) for e, c, x in rows if (e, c) == stratum)
        passing = [x for i, x in enumerate(p) if x <= rate * (i + 1) / len(p)]
        assert got.get(stratum) == (round(-math.log10(max(passing)) * 10) if passing else None)


def test_upper_case_digests_and_keys_are_found(spark):
    rng = random.Random(14)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("0123456789ABCDEF", 40), (string.ascii_uppercase + "234567", 52), (string.ascii_lowercase + string.digits, 40)) for _ in range(20)]
    got = spans(spark, list(enumerate(f"see {k} there" for k in keys)))
    assert sum(bool(got[i]) for i in range(60)) >= 52


def test_base_spans_are_not_covered_again(spark):
    key = "q9Zx7LmP2vB8nK4tR6wY1cJ5hF3gD0sAeUiOoTzQ"
    got = spans(spark, [(1, f"token = {key}"), (2, None), (2, "")])
    assert got[1] == [("assign", 0, 8 + len(key))]
    assert got[2] == []


def test_empty_table(spark):
    assert spans(spark, []) == {}
