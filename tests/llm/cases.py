"""Small tables with the cases that every operator must stand."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "rep", "digest", "n_words", "hits", "stratum", "declared", "host", "prior", "language", "base", "found", "slots", "kept", "component", "ids", "part", "shard", "curve", "a", "b"]

_rng = random.Random(5)
WORDS = [w + x for w in ("lumen", "tarn", "Oak", "rill", "é", "schön", "bar", "quo", "vex", "pli") for x in ("", "a", "is", "ent", "ó", "ing", "er", "um", "ät", "ol")]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + ("\n" if rng.random() < 0.03 else "") for _ in range(n))


BASE = prose(200, 1)
#: One word of 200 changed: similar by far over 0.8.
NEAR = BASE.replace(BASE.split()[100], "changed", 1)
#: A third of the words changed: not similar.
FAR = " ".join(w if k % 3 else "other" for k, w in enumerate(BASE.split()))
BENCHMARK = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short Item, here"), (30, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, None), (5, "... !"), (6, "ÄRGER über öl")]
PII = "write to a.b@c.org%x@d.net or 10.0.0.1, 300.1.1.1 and 1.2.3.4.5.6.7.8; pay 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (555) 010-9999 or +12 é é 3"

TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "ONE two THREE", "one two three four", BASE, BASE, NEAR, FAR, NEAR,
    prose(20_000, 2), "word " * 3000, "line one here\n" * 40, PII, "é" * 50 + " " + PII, "x ALPHA beta-gamma delta epsilon zeta eta, theta iota kappa lambda mu! y",
    "a short item here short ITEM here", "ärger über öl ärger Über öl", "alpha beta gamma delta epsilon zeta eta theta iota", "## ** $$ %% && || <> ##", "<|endoftext|> and <|startoftext|>x<|ENDOFTEXT|>",
    "don't,'re ok.' \xa0 a b \x1c z ﷽ 😀😀", "9" * 400, "@" * 300 + "a" * 300, "1.1.1." * 50, "a\x00b\x00\x00c d", "+" * 100 + "1" * 30,
]
ROWS = [(k, t, [None, "en", "fr", "de"][k % 4], ["src0", "src0", None, f"s{k}"][k % 4], None if t is None else len(t)) for k, t in enumerate(TEXTS)]
ROWS += [(7, BASE, "de", "s7", len(BASE)), (None, BASE, None, None, None), (None, prose(80, 9), "en", "src0", 1)]
