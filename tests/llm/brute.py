"""Plain Python versions of the operators, from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "[\x20\x09-\x0d]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def near(docs):
    """id -> (shingles, component) of (id, text)."""
    sets = {}
    for i, t in docs:
        w = words(low(t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeated_windows(docs, k=20):
    """id -> (words, removed, digest), in the given order."""
    seen, out = set(), {}
    for i, t in docs:
        w, gone = words(t), set()
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if g in seen:
                gone.update(range(p, p + k))
            seen.add(g)
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def repeated_bytes(docs, k=50):
    """id -> (bytes, removed, spans, digest)."""
    least, out = {}, {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            g = b[p : p + k]
            least[g] = min(least.get(g, i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if least[b[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def hits(docs, items, k=13):
    """id -> (words, hit, items, digest, contaminated)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    sizes = {len(g) for g in windows}
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def base_counts(text):
    """(words, characters in them, symbols, repeated lines, repeated words, failed)."""
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    covered = {q for p in range(len(w) - 4) if grams[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
}


def digits(m):
    return re.sub("[^0-9]", "", m)


def base_matches(text):
    """kind -> places of all matches, of whatever value."""
    return {kind: [m.span() for m in re.finditer(pattern, text or "")] for kind, (pattern, _) in _BASE.items()}


def base_spans(text):
    """kind:start:end of the base patterns, by kind."""
    return [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in _BASE.items() for m in re.finditer(pattern, text or "") if ok(m[0])]


def found_spans(docs, loose, rounds, accept, least):
    """id -> spans that the pattern graph adds to the base ones."""
    import regex

    before = regex.compile(r"(?:([\p{L}\p{N}_]+)[^\p{L}\p{N}\s]*\s+)?([\p{L}\p{N}_]+)[^\p{L}\p{N}\s]*[\s:=|]+[(\[]*$")
    after = regex.compile(r"^[)\]]*[\s,.;:]*([\p{L}\p{N}_]+)")
    mentions = []
    for i, text in docs:
        text = text or ""
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(text))]
        slots = [(k, m.start(), m.end()) for k, p in loose.items() for m in regex.finditer(p, text)]
        # what stands between a match and its neighbours of the same shape
        raw = {True: base_matches(text), False: {k: [m.span() for m in regex.finditer(p, text)] for k, p in loose.items()}}
        for seed, spans in ((True, base), (False, slots)):
            for k, a, b in spans:
                ends = [e for _, e in raw[seed][k] if e <= a]
                heads = [s for s, _ in raw[seed][k] if s >= b]
                left, right = text[max([a - 64, *ends[-1:]]) if ends else max(0, a - 64) : a], text[b : min([b + 64, *heads[:1]])]
                m, n = before.search(left), after.search(right)
                two, word = ((m[1] or "").lower(), m[2].lower()) if m else ("", "")
                seen = [f"{word} *"] if word else []
                seen += [f"{two} {word} *"] if word and two else []
                seen += [f"{word} * {n[1].lower()}"] if word and n else []
                if not seed and (not seen or any(x < b and a < y for _, x, y in base)):
                    continue
                value = text[a:b].lower() if k == "email" else re.sub("[^0-9]", "", text[a:b])
                mentions.append((i, a, b, k, value, seen, seed))
    seeds = {(k, v) for _, _, _, k, v, _, seed in mentions if seed}
    edges = Counter((k, p, v) for _, _, _, k, v, seen, _ in mentions for p in seen)
    known = Counter((k, p) for k, p, v in edges if (k, v) in seeds)
    edges = {x: n for x, n in edges.items() if known[x[:2]] >= least}
    score = {(k, v): float((k, v) in seeds) for k, _, v in edges}
    for _ in range(rounds):
        total, weight, miss = Counter(), Counter(), defaultdict(lambda: 1.0)
        for (k, p, v), n in edges.items():
            total[k, p] += n * score[k, v]
            weight[k, p] += n
        for k, p, v in edges:
            miss[k, v] *= max(1e-12, 1 - total[k, p] / weight[k, p])
        score = {x: 1.0 if x in seeds else 1 - miss[x] for x in score}
    out = {i: set() for i, _ in docs}
    for i, a, b, k, v, _, seed in mentions:
        if not seed and score.get((k, v), 0) >= accept:
            out[i].add((a, b, k))
    return {i: sorted(x) for i, x in out.items()}
