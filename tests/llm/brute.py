"""Plain versions of the contracts, to hold the operators against on small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    sets = defaultdict(set)
    for i, t in items:
        w = word(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            sets[tuple(w[j : j + k])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = word(t), set(), set()
        for k in {len(x) for x in sets}:
            for j in range(len(w) - k + 1):
                if own := sets.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def secrets(docs):
    """{doc_id: (n_assign, n_access, n_hex, base_sha256)}"""
    kinds = {
        "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    out = {}
    for d, t in docs:
        found = [(m.start(), r, m.end(), k) for r, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m)]
        n = Counter(x[3] for x in found)
        out[d] = (n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))))
    return out


def quality(docs):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)}"""
    out = {}
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        again = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
    return out


def verdicts(rows, weight=200):
    """{doc_id: kept} by the rules' fences, from (doc_id, lang, source, text), with buckets of 7 leading bits."""
    counts = quality([(d, t) for d, _, _, t in rows])
    values = {}
    for d, lang, source, t in rows:
        n, chars, symbols, dups, again, _ = counts[d]
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        echo = sum(a == b for a, b in zip(w, w[1:]))
        for name, top, factor, bottom in (("length", chars, 100, n), ("symbols", symbols, 1000, n), ("dups", dups, 1000, lines), ("again", again, 1000, n), ("echo", echo, 1000, n)):
            if bottom:
                values[name, d] = factor * top // bottom
    rules = {"length": (75, 12, 5), "symbols": (75, 6, 10), "dups": (90, 2, 175), "again": (90, 2, 145), "echo": (75, 15, 2)}
    cut = lambda x: x >> max(x.bit_length() - 7, 0) << max(x.bit_length() - 7, 0)
    bad = {d for d, c in counts.items() if c[5]}
    for name, (p, times, least) in rules.items():
        def at(group):
            x = sorted(cut(values[name, d]) for d, *_ in group if (name, d) in values)
            return len(x), [x[-(-q * len(x) // 100) - 1] if x else 0 for q in (25, 50, p)]
        n_all, every = at(rows)
        for d, lang, source, _ in rows:
            if (name, d) not in values:
                continue
            n_lang, by_lang = at([r for r in rows if r[1] == lang])
            n, own = at([r for r in rows if r[1:3] == (lang, source)])
            outer = [(n_lang * a + weight * b) // (n_lang + weight) for a, b in zip(by_lang, every)]
            low, mid, up = ((n * a + weight * b) // (n + weight) for a, b in zip(own, outer))
            x = values[name, d]
            if x > up + times * max(up - mid, least) or name == "length" and x < low - times * max(mid - low, least):
                bad.add(d)
    return {d: d not in bad for d in counts}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component_id, kept)}"""
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared, up = Counter(), {d: d for d in sets}
    for x in by.values():
        for i, a in enumerate(x):
            for b in x[i + 1 :]:
                shared[a, b] += 1

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def passages(docs, size=50):
    """{doc_id: (n_words, words in windows of ``size`` words that occur twice or more)}"""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    n = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    return {d: (len(w), len({j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})) for d, w in words.items()}
