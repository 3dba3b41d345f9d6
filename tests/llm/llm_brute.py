"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import json
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def exact(rows):
    """rows of (doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), *order(i), i))
    out = []
    for body, members in groups.items():
        best = min(members)
        out += [(m[3], best[3], len(members), m == best, sha(body)) for m in members]
    return sorted(out, key=repr)


def _removed(rows, symbols, width):
    """For each row which symbols a window of an earlier id covers."""
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        s = symbols(t)
        for p in range(len(s) - width + 1):
            first.setdefault(tuple(s[p : p + width]), order(i))
    for i, t in rows:
        s = symbols(t)
        covered = [False] * len(s)
        for p in range(len(s) - width + 1):
            if first[tuple(s[p : p + width])] < order(i):
                covered[p : p + width] = [True] * width
        yield i, s, covered


def repeated_bytes(rows, width=50):
    out = []
    for i, s, covered in _removed(rows, lambda t: (t or "").encode(), width):
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, len(s), sum(covered), runs, sha(bytes(b for b, c in zip(s, covered) if not c))))
    return sorted(out, key=repr)


def repeated_words(rows, width=13):
    out = []
    for i, s, covered in _removed(rows, words, width):
        out.append((i, len(s), sum(covered), sha(" ".join(w for w, c in zip(s, covered) if not c))))
    return sorted(out, key=repr)


def shingles(text, n):
    w = words(lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n, percent):
    sets = [(order(i), i, shingles(t, n)) for i, t in rows]
    parent = {o: o for o, _, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (oa, _, a) in enumerate(sets):
        for ob, _, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(oa), find(ob)
                parent[max(x, y)] = min(x, y)
    names = {o: i for o, i, _ in sets}
    return sorted(((i, len(s), names[find(o)]) for o, i, s in sets), key=repr)


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def license_base(rows, phrases):
    out = []
    for i, t in rows:
        w = license_words(t)
        found = [
            (label, s, s + len(p.split()) - 1) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()
        ]
        labels = ",".join(sorted({x for x, _, _ in found}))
        out.append((i, len(w), len(found), min((a for _, a, _ in found), default=None), max((b for _, _, b in found), default=None), labels))
    return sorted(out, key=repr)


def license_scan(rows, phrases, templates, label_of, min_score):
    """doc_id, base labels, all labels, score: every template at every place."""
    out = []
    for i, t in rows:
        w = license_words(t)
        at = lambda s, ws: 0 <= s and w[s : s + len(ws)] == ws
        base = {label for p, label in phrases.items() if any(at(s, p.split()) for s in range(len(w)))}
        scores = {}
        for name, (text, key) in templates.items():
            text, key = license_words(text), license_words(key)
            o = next(o for o in range(len(text)) if text[o : o + len(key)] == key)
            for s in range(-o, len(w)):
                if at(s + o, key):
                    met = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(text))
                    scores[name] = max(scores.get(name, 0), met / len(text))
        scores = {name: score for name, score in scores.items() if score >= min_score}
        labels = base | {label_of.get(name, name) for name in scores}
        out.append((i, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(scores.values(), default=0.0)))
    return sorted(out, key=repr)


def quality(rows):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for i, t in rows:
        t = t or ""
        w = words(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [line for line in t.split("\n") if words(line)]
        failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), failed))
    return sorted(out, key=repr)


def held_out(doc_id):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 5 == 1


def lattice(rows, model_path):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import sentencepiece

    docs = [(i, words(lower(t or ""))) for i, t in rows]
    count = collections.Counter(w for i, ws in docs if not held_out(i) for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = collections.Counter(p for w, k in count.items() if w is not None for p in sp.encode(w) for _ in range(k))
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
    total = sum(pieces[i] for i in usable) + count[None] + 0.5 * (len(usable) + 1)
    p = {sp.id_to_piece(i): (pieces[i] + 0.5) / total for i in usable if not sp.is_byte(i)}
    byte = [(pieces[sp.piece_to_id(f"<0x{b:02X}>")] + 0.5) / total for b in range(256)]

    def marginal(word):
        s, f = "▁" + word, [1.0]
        for j in range(1, len(s) + 1):
            f.append(sum(f[i] * p.get(s[i:j], 0.0) for i in range(j)))
            if s[j - 1] not in p:
                f[j] += f[j - 1] * math.prod(byte[b] for b in s[j - 1].encode())
        return math.log10(f[-1])

    out = []
    for i, ws in docs:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])
        score = sum(map(marginal, ws)) + math.log10((count[None] + 0.5) / total)
        out.append((i, held_out(i), len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), n, base, score))
    return sorted(out, key=lambda r: json.dumps(r[:3]))


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source by resharing the excess until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= most * sizes[s]}
        if not above:
            out.update(share)
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= above
    return out


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
        won[best] += 1
    return won


def chats(rows):
    """rows of (conv, turn, role, text) -> (conv, n, turns sha, loss chars, loss sha)."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)
