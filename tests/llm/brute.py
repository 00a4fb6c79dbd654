"""Plain Python versions of the contracts, for tests."""

import re
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def near_components(rows, size=4, percent=80):
    """{doc_id: (n_shingles, component)} by an exact prefix-filter join of all pairs."""
    sets = {d: shingles(t, size) for d, t in rows}
    total = Counter(s for x in sets.values() for s in x)
    by_set = defaultdict(list)
    for d, x in sets.items():
        by_set[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for x, ds in by_set.items():
        if x:
            for d in ds[1:]:
                join(ds[0], d)
    index = defaultdict(list)
    pairs = set()
    reps = [(ds[0], x) for x, ds in by_set.items() if x]
    for d, x in reps:
        ordered = sorted(x, key=lambda s: (total[s], s))
        seen = set()
        for s in ordered[: len(x) - -(-percent * len(x) // 100) + 1]:
            seen.update(index[s])
            index[s].append(d)
        for e in seen:
            y = sets[e]
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                pairs.add((e, d))
                join(d, e)
    return {d: (len(x), root(d)) for d, x in sets.items()}, pairs


BLANK = "\x20\x09-\x0d"


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(f"[^{BLANK}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    places = defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    repeated = {j for at in places.values() if len(at) > 1 for k in at for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


KINDS = ("email", "ip", "card", "phone")


def base_spans(text):
    """[(start, kind number, end)] as the contract's own patterns give them."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text, spans):
    """The text with its spans, which are in order, replaced by their kinds; one that begins inside an earlier one goes with it."""
    if text is None:
        return None
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pattern_scores(slots, rounds, least_score, least_seeds, doubt):
    """{(context, kind): (score, seeds)} of slots (context, core, kind or None)."""
    edges, kinds = Counter(), {}
    for context, core, kind in slots:
        edges[context, core] += 1
        if kind is not None:
            kinds[context, core] = max(kind, kinds.get((context, core), kind))
    known = {}
    for (_, core), kind in kinds.items():
        known[core] = max(kind, known.get(core, kind))
    totals = Counter()
    for (context, _), n in edges.items():
        totals[context] += n
    instances = {core: (kind, 1.0) for core, kind in known.items() if core is not None}
    for k in range(rounds):
        hit, seeds = defaultdict(float), Counter()
        for (context, core), n in edges.items():
            if core in instances:
                kind, weight = instances[core]
                hit[context, kind] += n * weight
                seeds[context, kind] += weight == 1.0
        scores = {(c, kind): (x / (totals[c] + doubt), seeds[c, kind]) for (c, kind), x in hit.items()}
        if k == rounds - 1:
            return scores
        left = defaultdict(lambda: 1.0)
        for context, core in edges:
            if core is None or (context, core) in kinds or core in known:
                continue
            for (c, kind), (score, n) in scores.items():
                if c == context and score >= least_score and n >= least_seeds:
                    left[core, kind] *= max(1 - score, 1e-9)
        instances = {core: (kind, 1.0) for core, kind in known.items() if core is not None}
        for core in {core for core, _ in left}:
            weight, kind = max((1 - x, kind) for (c, kind), x in left.items() if c == core)
            instances[core] = (kind, min(weight, 0.999))


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def decontaminate(text, items, window=10):
    """(n_words, n_hit, item ids) of a text against [(item_id, text)]."""
    words, hit, found = bench_words(text), set(), set()
    for item, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for at in range(len(words) - len(part) + 1):
                if words[at] == part[0] and words[at : at + len(part)] == part:
                    found.add(item)
                    hit.update(range(at, at + len(part)))
    return len(words), len(hit), found
