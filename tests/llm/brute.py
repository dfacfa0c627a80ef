"""The same results in plain Python, one text or pair at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def components(docs, n, num, den):
    """(set size, least id of the component) per position of docs, a list of (id, text)."""
    sets = [shingle_set(t, n) for _, t in docs]
    held = defaultdict(list)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, overlap in Counter(j for g in s for j in held[g]).items():
            if den * overlap >= num * (len(s) + len(sets[j]) - overlap):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(len(s), (least.get(root(i)) if s else docs[i][0])) for i, s in enumerate(sets)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)


def secrets(text):
    rules = (
        (r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def lm(docs, least=2, discount=0.75):
    tokens = [[*words(t), b"</s>"] for _, t in docs]
    tokens = [[w if w is not tokens[i][-1] or k + 1 < len(tokens[i]) else "end" for k, w in enumerate(ws)] for i, ws in enumerate(tokens)]
    uni, bi, starts = Counter(), Counter(), 0
    for (d, _), ws in zip(docs, tokens, strict=True):
        if not held_out(d):
            uni.update(ws)
            bi.update(zip(["start", *ws], ws, strict=False))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    seen = Counter(uni) + Counter({"start": starts})
    mass = Counter()
    for (h, _), c in bi.items():
        mass[h] += c - discount if c >= least else 0
    out = []
    for (d, _), ws in zip(docs, tokens, strict=True):
        base = score = 0.0
        for h, w in zip(["start", *ws], ws, strict=False):
            p = (uni[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if seen[h]:
                kept = bi[h, w] if bi[h, w] >= least else 0
                p = (kept - discount if kept else 0) / seen[h] + (1 - mass[h] / seen[h]) * p
            score += math.log10(p)
        out.append((d, held_out(d), len(ws), sum(uni[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return out


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def fails_other_rules(text):
    """The quality rules beyond the word count and repeated words."""
    t = text or ""
    n, chars, symbols, dup, _ = quality(t)
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    letters = sum(any(c.isalpha() for c in x) for x in w)
    dots = sum(x.rstrip(" \t\n\x0b\f\r").endswith(("...", "…")) for x in lines)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[•‣▪●*-][\x20\x09]", x)) for x in lines)
    return chars > 15 * n or 10 * chars < 15 * n or 10 * symbols > 3 * n or 10 * dup > 3 * len(lines) or 10 * letters < 8 * n or (dots >= 5 and 10 * dots > 3 * len(lines)) or (bullets >= 5 and 10 * bullets > 9 * len(lines))
