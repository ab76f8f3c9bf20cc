"""Plain versions of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, k, kind, e in sorted(spans)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_passages(rows, window=13):
    """{doc_id: (n_words, n_removed, kept_sha256)} for [(doc_id, text)]."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def mixed(rows, most=3, seed="2024"):
    """{(doc_id, text, source): (size, source_size, target, taken)} for [(doc_id, text, source)]: all documents of a source in order of their hash."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda d, t: int(hashlib.md5(f"{seed}:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((h(d, t), size(t), d, t))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total = {s: sum(x[1] for x in v) for s, v in by.items()}
    capped = set()
    while True:
        left, shares = sum(total.values()) - most * sum(total[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * left > most * total[s] * shares}
        if not more:
            break
        capped |= more
    out = {}
    for s, v in by.items():
        target = float(most * total[s]) if s in capped else weight[s] * left / shares
        whole = int(target // total[s]) if total[s] else 0
        rest, below, groups = target - whole * total[s], 0, {}
        for x in v:
            groups.setdefault(x[0], []).append(x)
        for key in sorted(groups):
            n = sum(x[1] for x in groups[key])
            extra = rest > 0 and (below + n <= rest or below <= rest and n - (rest - below) < rest - below)
            for _, k, d, t in groups[key]:
                out[d, t, s] = (k, total[s], target, k * (whole + extra))
            below += n
    return out


def fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices."""
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def resampled(rows, target, low=1, high=1, buckets=10000, percent=10, least=20, seed="2024"):
    """[(doc_id, text, n_features, weight, score, rank)] for [(doc_id, text)], drawn ones first."""
    import math
    import zlib

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]
    of = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(words(t))]
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for b in of(x):
            s[b] += 1
    for x in target:
        for b in of(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, x in rows:
        b = of(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[i] for i in b)
        out.append((d, x, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if len(words(r[1])) >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = percent * len(able) // 100
    return [(*r, i + 1 if i < k else None) for i, r in enumerate(able)] + [(*r, None) for r in out if len(words(r[1])) < least]
