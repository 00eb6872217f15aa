"""Awkward documents and brute-force versions of the operators."""

import hashlib
import re

import xxhash

LONG = " ".join(f"w{i % 700}" for i in range(60_000))
PASSAGE = " ".join(f"Shared{i}" for i in range(70))


def rows():
    """Documents with all the awkward cases: nulls, empty, very long, repeated, ties."""
    plain = [" ".join(f"d{n}x{i}" for i in range(80)) for n in range(6)]
    near = plain[0].split(" ")
    texts = [
        (1, plain[0]), (2, " ".join([*near[:78], "a", "b"])), (3, plain[0]), (3, plain[0]),
        (4, None), (5, ""), (6, "one"), (7, "  \n\t "), (8, LONG), (9, f"{plain[1]} {PASSAGE}"),
        (10, f"{PASSAGE} {plain[2]}"), (11, f"a b {PASSAGE} c"), (None, plain[3]), (12, plain[3]),
        (13, "x\ny\nz\nq\n" + plain[4]), (14, "x\ny\nz\nx\ny\nz\n"), (15, "the the the the " * 40),
        (16, "Ünïcödé 😀 日本語 a@b.org +1 (523) 555-1055 10.0.0.1 " * 3), (17, "!!! ### | | 7 7"),
    ]
    return [(i, t, "en" if i is None or i % 2 else None, f"s{(i or 0) % 3}") for i, t in texts]

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}.get(kind, lambda: True)()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def brute_hits(docs, items):
    wanted = {}
    for item, text in items:
        w = ALNUM.findall(low(text))
        n = min(len(w), 10)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wanted.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    found |= wanted[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return out


def brute_removal(docs, span):
    windows = {}
    split = [(i, SPACED.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - span + 1):
            key = tuple(w[k:k + span])
            windows[key] = min(windows.get(key, i), i)
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - span + 1) if windows[tuple(w[k:k + span])] < i
                for p in range(k, k + span)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def sets_of(docs, width):
    out = {}
    for i, t in docs:
        w = SPACED.findall(low(t))
        grams = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        out.setdefault(i, grams)
    return out


def brute_groups(docs, width):
    sets = sets_of(docs, width)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def mark(text):
    """The hash that tells texts of one id apart."""
    return (xxhash.xxh64_intdigest((text or "").encode(), seed=42) + 2**63) % 2**64 - 2**63


def brute_lines(docs):
    first, places = {}, []
    for i, _, t in sorted({(i, mark(t), t or "") for i, t in docs}):
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if SPACED.search("".join(w)):
                places.append((i, t, k, w))
                first.setdefault(w, (i, t, k))
    gone = {}
    for i, t, k, w in places:
        if first[w] != (i, t, k):
            gone.setdefault((i, t), set()).update((k, k + 1, k + 2))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        g = gone.get((i, t or ""), set())
        left = "\n".join(x for k, x in enumerate(lines) if k not in g) if g else t
        out.append((i, left, len(lines) if t else 0, len(g)))
    return out
