"""Plain Python versions of the training-data operators, for small inputs."""

import collections
import itertools
import math
import re

import numpy as np
import regex

from groundwell.llm import decontaminate as dc
from groundwell.llm import license_scan, toxicity
from groundwell.llm import wordhash as wh


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def components(ids, linked):
    """The smallest reachable id of each id; linked: pairs."""
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_duplicates(rows, size, percent=80):
    """{doc_id: (shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    pairs = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            pairs.append((a, b))
    part = components(sets, pairs)
    return {d: (len(s), part[d]) for d, s in sets.items()}


def line_words(line):
    return [w for w in re.split(r"[ \t\x0b\f\r]+", line) if w]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def line_dedup(rows):
    """{doc_id: kept lines, or None for a null text} of (doc_id, text) rows with distinct ids."""
    lines = [(d, i, line_words(line)) for d, text in sorted(rows) if text is not None for i, line in enumerate(text.split("\n"))]
    gone, first = set(), {}
    for d, i, w in lines:
        if w and tuple(w) in first:
            gone.add((d, i))
        elif w:
            first[tuple(w)] = (d, i)
    order = list(first.items())
    for k, (w, at) in enumerate(order):
        if len(w) >= 5 and any(len(v) >= 5 and one_edit(list(w), list(v)) for v, _ in order[:k]):
            gone.add(at)
    return {d: None if text is None else [x for i, x in enumerate(text.split("\n")) if (d, i) not in gone] for d, text in rows}


def template(text):
    """[(word, value)] of the template: word is a placeholder or literal, value what it stands for."""
    units = "|".join(sorted(map(re.escape, dc.UNITS), key=len, reverse=True))
    name = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?!(?:{'|'.join(dc.OPENERS)})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{Ll}}{{1,40}}(?: \p{{Lu}}\p{{Ll}}{{1,40}}){{0,{dc.NAME_WORDS - 1}}}(?![\p{{L}}\p{{N}}])")
    number = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[0-9]+(?:[.,:/][0-9]+)?(?:[.,:/][0-9]+)?(?=[^\p{{L}}\p{{N}}]|$|(?:{units})(?![\p{{L}}\p{{N}}]))")
    unit = regex.compile(rf"([ \t\n\x0b\f\r]+)({units})(?![\p{{L}}\p{{N}}])|({units})(?![\p{{L}}\p{{N}}])")
    out, at, text = [], 0, text or ""

    def plain(part):
        return [(w, w) for w in regex.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.lower()) if w]

    marks = sorted([(m.start(), m.end(), dc.NAME, m[0]) for m in name.finditer(text)] + [(m.start(), m.end(), dc.NUMBER, m[0]) for m in number.finditer(text)])
    for begin, end, mark, value in marks:
        out += plain(text[at:begin])
        out.append((mark, value.lower()))
        at = end
        if mark == dc.NUMBER:
            m = unit.match(text, at)
            if m:
                out.append((dc.UNIT, (m[2] or m[3]).lower()))
                at = m.end()
    return out + plain(text[at:])


def leaks(docs, items, window=dc.WINDOW, least_share=0.5):
    """{(doc_id, item_id): share} by comparing all windows."""
    found, seen = {}, set()
    for item, text in sorted(items, key=lambda r: r[0]):
        theirs = template(text)
        if not theirs or text in seen:
            continue
        seen.add(text)
        n, size = len(theirs), min(len(theirs), window)
        literal = [w not in (dc.NUMBER, dc.UNIT, dc.NAME) for w, _ in theirs]
        for d, doc in docs:
            ours = template(doc)
            hits, copies = collections.defaultdict(set), set()
            for at in range(n - size + 1):
                telling = 2 * sum(literal[at : at + size]) >= size >= dc.LEAST_WORDS
                for place in range(len(ours) - size + 1):
                    a, b = theirs[at : at + size], ours[place : place + size]
                    if telling and [w for w, _ in a] == [w for w, _ in b]:
                        hits[place - at].add(at)
                    elif not telling and a == b:
                        copies |= set(range(at, at + size))
            covered = set(copies)
            for offset, starts in hits.items():
                placed = {k for at in starts for k in range(at, at + size)}
                slots = {(theirs[k][1], theirs[k][0], ours[k + offset][1]) for k in placed if not literal[k]}
                pairs = {((m, a), (m, b)) for a, m, b in slots}
                if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
                    changed = {k for k in placed if not literal[k] and theirs[k] != ours[k + offset]}
                    starts = {at for at in starts if not changed & set(range(at, at + size))}
                    placed = {k for at in starts for k in range(at, at + size)}
                covered |= placed
            if len(covered) / n >= least_share:
                found[d, item] = len(covered) / n
    return found


def license_row(text, rules):
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    w = [x for x in re.split(license_scan.SEPARATORS, low(text)) if x]
    line = " " + " ".join(w) + " "
    places = []
    for k, rule in enumerate(rules):
        if not set(rule.keyword.split("|")) & set(w):
            assert not re.search(f"(?<= )(?:{rule.pattern})(?= )", line)
            continue
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            places.append((start, start + m[0].count(" ") + 1, rule.priority, k))
    left = [p for p in places if not any(q != p and q[0] <= p[0] and q[1] >= p[1] and q[2] >= p[2] and ((q[0], -q[1], -q[2], q[3]) < (p[0], -p[1], -p[2], p[3])) for q in places)]
    base = [p for p in places if rules[p[3]].base]
    labels = {rules[p[3]].label for p in base + left}
    return (len(w), len(base), min((p[0] for p in base), default=None), max((p[0] for p in base), default=None), ",".join(sorted({rules[p[3]].label for p in base})), ",".join(sorted(labels)), 1 - 2.0 ** -sum(p[2] for p in left))


def sentence_scores(text, model):
    """The probability of each sentence, in plain Python."""
    out = []
    for part in re.split(rb"[.!?\n]", (text or "").encode()):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)
        if tokens:
            z = model.bias
            for w in tokens:
                own = word_hash(w) % toxicity.BUCKETS
                head = int(wh.mix(np.array([word_hash(w[: toxicity.HEAD_BYTES]) + 1 & (1 << 64) - 1], np.uint64))[0]) % toxicity.BUCKETS
                z += float(model.weights[own]) + float(model.weights[head])
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
    return out


def word_hash(raw):
    data = np.frombuffer(raw, np.uint8)
    return int(wh.word_hashes(data, np.array([0]), np.array([len(data)]))[0])
