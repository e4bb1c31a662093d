"""Plain versions of the operators for small tables."""

import hashlib
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset((len(words) < k, *words[i : i + k]) for i in range(len(words) - k + 1))


def components(data, k, num, den):
    """(doc_id, set size, component) of each row; rows of one doc_id are one node."""
    sets = [(i, shingles(t, k)) for i, t in data]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


def contamination(data, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.add((str(item) if item is not None else "null", tuple(w[i : i + 10])))
    out = []
    for doc_id, text in data:
        w, hit, names = split(text), set(), set()
        for item, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    names.add(item)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def repeats(data, width):
    docs = [(i, WORD.findall(t or "")) for i, t in data]
    seen = Counter(tuple(w[p : p + width]) for _, w in docs for p in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                keep[p : p + width] = [False] * width
        kept = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def secrets(data):
    out = []
    for i, text in data:
        spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n]
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        out.append((i, *counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()))
    return sorted(out, key=str)


def quality(data):
    out = []
    for i, text in data:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        hit = {q for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        n = len(w)
        out.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n))
    return sorted(out, key=str)


def merge_dropout(text, model, own):
    """Ids of a text: an agenda as a list, looked over again for each turn; the model gives scores and draws only."""
    blank, key = "▁", model.key(own)
    text = " " + text if text else ""
    inside = {c for p in model.id_of for c in p}
    ids, at = [], 0
    while at < len(text):
        c = text[at]
        if c == blank or (c != " " and c not in inside):
            ids += [model.byte[b] for b in c.encode()]
            at += 1
            continue
        stop = at
        while stop < len(text) and text[stop] == " ":
            stop += 1
        while stop < len(text) and text[stop] not in (" ", blank) and text[stop] in inside:
            stop += 1
        parts, dropped, turn = list(text[at:stop].replace(" ", blank)), set(), 0
        while True:
            places = [sum(map(len, parts[:i])) for i in range(len(parts))]
            open_ = [(model.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.rank and (places[i], len(a), len(b)) not in dropped]
            if not open_:
                break
            _, i = min(open_)
            if model.skips(key, at, turn):
                dropped.add((places[i], len(parts[i]), len(parts[i + 1])))
            else:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            turn += 1
        ids += [model.id_of[p] for p in parts]
        at = stop
    return ids


def lines(data, least=20, least_docs=3):
    """(doc_id, lines, dropped, digest); every row is a document."""
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    low = lambda i: float("-inf") if i is None else i
    docs = [(i, (t or "").split("\n")) for i, t in data]
    holders = {}
    for i, ls in docs:
        for k in {key(x) for x in ls}:
            if len(k) >= least:
                holders.setdefault(k, []).append(low(i))
    out = []
    for i, ls in docs:
        kept = [x for x in ls if len(key(x)) < least or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == low(i)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(data, crc, least_chars=7, least_found=2, ratio=10):
    """(word, form, root, n, n_near, form_n): every word against every other."""
    n = Counter()
    for i, text in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = crc(f"{'null' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return groups({w: k for w, k in n.items() if len(w) >= least_chars and k >= least_found}, ratio)


def groups(n, ratio=10):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def surrogates(data, key):
    """(doc_id, text, counts) with every entity of a list at once, without joins or broadcasts."""
    from veil.llm import surrogates as op

    found = {i: [(x, op.parts(x[2], x[3], t[x[0] : x[1]])) for x in op.detect(t, op.GIVEN)] if t else [] for i, (_, t) in enumerate(data)}
    entities = {p for own in found.values() for _, each in own for p in each}
    told = {}
    for kind, value in entities:
        if kind in ("name_f", "name_m", "name_n"):
            told.setdefault(value, set()).add(kind)
    gender = {v: "name_f" if "name_f" in k and "name_m" not in k else "name_m" if "name_m" in k and "name_f" not in k else "name_n" for v, k in told.items()}
    to = {(k, v): (gender[v] if k in ("name_f", "name_m", "name_n") else k, v) for k, v in entities}
    real, left, settled = set(to.values()), dict.fromkeys(to.values(), 0), {}
    while left:
        tried = {e: op.surrogate(*e, key, n) for e, n in left.items()}
        used = {(k, s) for (k, _), s in settled.items()}
        least = {}
        for (k, v), s in tried.items():
            least[k, s] = min(v, least.get((k, s), v))
        for (k, v), s in tried.items():
            if least[k, s] == v and (k, s) not in real | used:
                settled[k, v] = s
        left = {e: n + 1 for e, n in left.items() if e not in settled}
    out = []
    for i, (doc_id, text) in enumerate(data):
        n, new = Counter(), text
        for (a, b, kind, _), each in reversed(found[i]):
            n[kind] += 1
            new = new[:a] + op.written(kind, text[a:b], [settled[to[p]] for p in each]) + new[b:]
        out.append((doc_id, new, *[n[k] for k in op.KINDS]))
    return sorted(out, key=str)
