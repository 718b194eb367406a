"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(texts, width):
    """(words, removed, kept text) of each text."""
    ws = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, least=0.8, k=5):
    """{row: (members of its class, links)} of (doc_id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x] if j < i)
        for j, n in both.items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def chat(rows):
    """{conv_id: (n_turns, turns digest, loss_chars, loss digest)} of (conv_id, turn, role, text) rows."""
    import hashlib

    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def base_spans(text):
    """kind:start:end of the base kinds, by start and then kind."""
    text = text or ""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            twice = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(twice) % 10 == 0):
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def packed(documents, size, unit):
    """Sequences of (doc, start, length) that sum-of-squares packing makes of (doc, length) in order, by trying all places."""
    done, windows = [], []  # windows: lists of pieces, the latest of a level last
    fill = lambda w: sum(n for *_, n in w)
    open_ = lambda n: size - n >= unit

    def cost(fills):
        count = Counter(n // unit for n in fills if open_(n))
        return sum(c * c for c in count.values())

    for doc, n in documents:
        at = 0
        while n - at >= size:
            done.append([(doc, at, size)])
            at += size
        if at == n:
            continue
        latest = {fill(w) // unit: i for i, w in enumerate(windows)}
        fills = [fill(w) for w in windows]
        tries = [(cost([*fills, n - at]), 1, 0, -1)]
        for level, i in latest.items():
            if fills[i] + n - at <= size:
                tries.append((cost([*fills[:i], fills[i] + n - at, *fills[i + 1 :]]), 0, -level, i))
        *_, i = min(tries)
        window = [*(windows.pop(i) if i >= 0 else []), (doc, at, n - at)]
        if open_(fill(window)):
            windows.append(window)
        else:
            done.append(window)
    windows.sort(key=lambda w: (-fill(w), ))
    while windows:
        window = windows.pop(0)
        while fill(window) < size and windows:
            doc, at, n = windows[-1].pop()
            take = min(n, size - fill(window))
            window.append((doc, at, take))
            if take < n:
                windows[-1].append((doc, at + take, n - take))
            if not windows[-1]:
                windows.pop()
        done.append(window)
    return done


def chat_windows(bodies, sizes, has_system, budget, history, history_tokens, segment):
    """Formatted windows of one conversation's turns, by a plain loop."""
    out, used, cell, first = [], None, None, 0
    at = 0
    for i, (body, size) in enumerate(zip(bodies, sizes, strict=True)):
        if (new := at // (segment * budget)) != cell:
            cell, used, first = new, None, i
        at += size
        if used is not None and used + size <= budget:
            out[-1] += body
            used += size
            continue
        system = has_system and i > 0 and sizes[0] + size <= budget
        room = min(history_tokens, budget - system * sizes[0] - size)
        least = max(first, 1 if has_system else 0)
        back = max([0, *(k for k in range(1, history + 1) if i - k >= least and sum(sizes[i - k : i]) <= room)])
        used = system * sizes[0] + sum(sizes[i - back : i]) + size
        out.append((bodies[0] if system else "") + "".join(bodies[i - back : i]) + body)
    return out


def line_fails(line, phrases):
    """Whether line-first cleaning removes a line that has a word."""
    import regex

    ws = words(line)
    parts = regex.split("[|»›·•]", line)
    named = 0
    for part in parts[:-1]:  # separators with a letter or digit since the one before, from the first on
        if not regex.search(r"[\p{L}\p{N}]", part):
            break
        named += 1
    links = sum(bool(regex.match(r"(?:https?://|www\.).", w)) for w in ws)
    ends = any(regex.search("[.!?…。][)\"'”’»*]*$", w) for w in ws)
    signs = sum(bool(regex.search("(?:[#*$%&<>=~^]{2,}|!!+)$", w)) for w in ws)
    return (
        (len(ws) <= 20 and any(p in line.lower() for p in phrases))
        or (named >= 3 and len(ws) <= 6 * len(parts))
        or (links >= 2 and 2 * links >= len(ws))
        or (len(ws) >= 8 and not ends)
        or signs >= 0.3 * len(ws)
        or (bool(regex.search(r"\p{Lu}", line)) and not regex.search(r"\p{Ll}", line) and len(ws) >= 2)
    )


def tiling_words(text):
    import regex

    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])[\p{L}\p{M}\p{N}])+", (text or "").lower())


def tiled(text, item, k):
    """(words of the item, words covered) by greedy string tiling that looks for the longest unmarked match again each time."""
    a, b = tiling_words(text), tiling_words(item)
    marked_a, marked_b = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return len(b), sum(marked_b)
        marked_a[i : i + n] = marked_b[j : j + n] = [True] * n


def pii_spans(text, model, patterns, threshold=0.5):
    """All spans, the added ones by the plain classifier over plain features of plain matches."""
    import math

    import regex

    text = text or ""
    base = [tuple(x.split(":")) for x in base_spans(text).split(",") if x]
    ranks = ["email", "ip", "card", "phone", "secret", "number", "person"]
    out = [(int(a), ranks.index(k), int(b), k) for k, a, b in base]
    taken = [(int(a), int(b)) for _, a, b in base]

    def sign(c):
        return "none" if not c else "space" if c in " \t\n\x0b\f\r" else "letter" if regex.match(r"[\p{L}\p{N}]", c) else "path" if c in "/.@_-" else "mark"

    for kind, pattern in patterns.items():
        for m in regex.finditer(pattern, text):
            v = m[0]
            n, digits = len(v), sum(c in "0123456789" for c in v)
            lower, upper = bool(regex.search(r"\p{Ll}", v)), bool(regex.search(r"\p{Lu}", v))
            f = {
                "length": next((str(x) for x in (12, 20, 32, 48) if n < x), "more"),
                "digits": "none" if not digits else "few" if digits * 2 < n else "most" if digits < n else "all",
                "before": sign(text[max(0, m.start() - 1) : m.start()]),
                "after": sign(text[m.end() : m.end() + 1]),
                "marks": "round" if set(v) & set("()") else "marks" if set(v) & set("-/.") else "spaces" if " " in v else "plain",
                "case": "both" if lower and upper else "lower" if lower else "upper" if upper else "none",
            }
            w = model.weights.get(kind)
            z = w["bias"] + sum(w.get(f"{k}={x}", 0.0) for k, x in f.items()) if w else -math.inf
            if w and 1 / (1 + math.exp(-z)) >= threshold and not any(a < m.end() and m.start() < b for a, b in taken):
                out.append((m.start(), ranks.index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def language_features(text, size, longest):
    """{feature: count} of the n-grams of the text's bytes, runs of what is no letter as one space."""
    out, raw = Counter(), []
    for b in text.lower().encode():
        b = b if b >= 128 or chr(b).isalpha() else 32
        if b != 32 or not raw or raw[-1] != 32:
            raw.append(b)
    for n in range(1, longest + 1):
        for i in range(len(raw) - n + 1):
            code = 0
            for b in raw[i : i + n]:
                code = (code * 256 + b + 1) % 2**32
            code = ((code ^ (code >> 15)) * 2654435761 + n * 0x9E3779B9) % 2**32
            out[(code * 0x85EBCA6B % 2**32) >> (32 - (size - 1).bit_length())] += 1
    return out


def languages(train, texts, size, longest, k, reach, slack):
    """(language, score, rejected) of each text, from (text, language) rows that are all taken."""
    from math import log1p, sqrt

    train = [(t.lower(), lang) for t, lang in train if t is not None and lang is not None]
    df = Counter(f for t, _ in train for f in language_features(t, size, longest))
    idf = lambda f: log1p(len(train) / (1 + df[f]))

    def unit(v):
        norm = sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if norm else v

    vector = lambda t: unit({f: sqrt(n) * idf(f) for f, n in language_features(t, size, longest).items()})
    dot = lambda a, b: sum(x * b.get(f, 0.0) for f, x in a.items())

    def mean(vs):
        out = Counter()
        for v in vs:
            for f, x in v.items():
                out[f] += x / len(vs)
        return dict(out)

    model = []
    for lang in sorted({lang for _, lang in train}):
        vs = [vector(t) for t in sorted({t for t, x in train if x == lang})]
        middle = mean(vs)
        picks = [max(range(len(vs)), key=lambda i: dot(vs[i], middle))]
        while len(picks) < min(k, len(vs)):
            picks.append(min(range(len(vs)), key=lambda i: max(dot(vs[i], vs[p]) for p in picks)))
        centres, own = [vs[p] for p in picks], [0] * len(vs)
        for _ in range(12):
            new = [max(range(len(centres)), key=lambda c: dot(v, centres[c])) for v in vs]
            centres = [unit(mean([v for v, o in zip(vs, new, strict=True) if o == c])) if c in new else centres[c] for c in range(len(centres))]
            if new == own:
                break
            own = new
        for c, centre in enumerate(centres):
            cosine = sorted(dot(v, centre) for v, o in zip(vs, own, strict=True) if o == c)
            if cosine:
                at = reach * (len(cosine) - 1)
                low = int(at)
                limit = cosine[low] + (at - low) * (cosine[min(low + 1, len(cosine) - 1)] - cosine[low]) - slack
            model.append((lang, centre, limit if cosine else 1.0))
    out = []
    for t in texts:
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0, True))
            continue
        v = vector(t)
        cosine = [dot(v, c) for _, c, _ in model]
        best = max(range(len(model)), key=lambda i: cosine[i])
        out.append((model[best][0], min(1.0, max(0.0, cosine[best])), cosine[best] < model[best][2]))
    return out
