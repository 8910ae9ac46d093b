"""Plain versions of the contracts, one text at a time, and awkward rows to try them on."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import unicodedata
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def quality(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, later = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            later += line in seen
            seen.add(line)
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), later, len(hit), base


def fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(nodes, linked):
    """Smallest index reachable from each; ``linked(i, j)`` tells of a link."""
    up = list(range(len(nodes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if root(i) != root(j) and linked(nodes[i], nodes[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(nodes))]


def repeated(sequences, window):
    """Per sequence, which members lie in a window that starts elsewhere too."""
    count = collections.Counter(tuple(s[k : k + window]) for s in sequences for k in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if count[tuple(s[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


def contaminated(text, items, window=10):
    w = ITEM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        v = ITEM_WORD.findall(lower(body))
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """``sizes`` by source; null is None and comes last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        for s in over or free:
            out[s] = most * sizes[s] if over else level * weight[s]
        if not over:
            break
        free -= set(over)
        left -= sum(out[s] for s in over)
    return out


PASSAGE = " ".join(f"shared{k} of the" for k in range(20))
LONG = " ".join(f"w{k * k % 977}x{k}" for k in range(3000))
BASE = " ".join(f"term{k}a{k * 7 % 13}" for k in range(120))
#: Nulls, empty texts, ties, equal rows, repeated ids, hot sources and passages, a very long text.
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("term5a", "other5a"), "en", "a"),
    (4, None, "en", "b"),
    (5, "", "fr", None),
    (6, " \t\n ", None, None),
    (7, "x", "fr", "b"),
    (8, "..., --- !!!", "fr", "b"),
    (None, "a text without an id " + PASSAGE, "en", "a"),
    (None, "a text without an id " + PASSAGE, "en", "a"),
    (9, PASSAGE + " then what follows here", "en", "c"),
    (10, "before it " + PASSAGE, "de", "c"),
    (11, LONG, "de", "a"),
    (12, "naïve café 你好 \U0001f600 " * 30, "fr", "a"),
    (13, "line one of the text is here again\nline one of the text is here again\n" * 10, "en", "d"),
    (14, "line one of the text is here again\nline two of the text is here again too", "en", "d"),
    (15, "z" * 5000, "en", "d"),
    (16, "<|endoftext|> don't IT'S 'street a1b2 İß \x1c\x85 é", "en", "d"),
    (17, LONG[:4000] + " " + PASSAGE + " " + LONG[:4000], "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark, rows=ROWS):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("key", "size", "kept", "n", "id", "fp", "taken", "words", "line", "slot", "label", "tie", "start"):
        out = out.withColumn(name, F.lit("other"))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best(rows, items, k=10):
    """``rows`` of (doc_id, text), ``items`` of (item_id, text): (item_id, rank, doc_id, score)."""
    held = [(d, collections.Counter(TERM.findall(lower(t)))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(size for _, _, size in held)
    df = collections.Counter(term for _, c, _ in held for term in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall(lower(text)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c, size in held:
            m = 10 + 90 * size * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms & c.keys()
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return out


def rearranged(doc, text, seed="7", rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def language_symbols(text):
    """Two boundaries, the lower-cased letters and marks with runs of all else as one boundary, a boundary."""
    s = ["", ""]
    for ch in text or "":
        x = ch.lower()[0] if ch.isalpha() else ch if unicodedata.category(ch)[0] == "M" else ""
        if x or s[-1]:
            s.append(x)
    return s if not s[-1] else [*s, ""]


def language_models(rows):
    """Counts of every gram and, per context, the sum of what follows it and the number of kinds, by language."""
    models = {}
    for lang, text in rows:
        s = language_symbols(text)
        own = models.setdefault(lang, collections.Counter())
        own.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    out = {}
    for lang, four in models.items():
        counts = {4: four}
        for order in (3, 2, 1):
            counts[order] = collections.Counter(g[1:] for g in counts[order + 1])
        if not four:
            continue
        out[lang] = counts
    return out


def language_p(counts, gram):
    order = len(gram)
    if not order:
        return 1 / 0x110000
    table = counts[order]
    lower = language_p(counts, gram[1:])
    follow = [n for g, n in table.items() if g[:-1] == gram[:-1]]
    if not follow:
        return lower
    once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    return (max(table[gram] - d, 0) + d * len(follow) * lower) / sum(follow)


def language_of(models, text):
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0
    s = language_symbols(text)
    grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
    found = {lang: -sum(math.log(language_p(c, g)) for g in grams) / len(grams) for lang, c in models.items()}
    best = min(sorted(found), key=found.get)
    return best, found[best]
