"""Small tables with everything that may go wrong, and plain versions to compare with."""

import re

LONG = "lorem ipsum dolor " * 20000
PROSE = "the quick brown fox jumps over the lazy dog while nine other animals watch from the far side of the old river bank"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, bucket int, block string, key string, start long, size string, n long, words string"


def messy(spark, rows=None):
    """Documents with nulls, empty, blank, long and repeated texts, repeated and missing ids,
    and extra columns named like the operators' own."""
    rows = rows if rows is not None else [
        (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, PROSE + " and one more", None), (4, None, "b"), (5, "", "b"), (6, " \n\t ", None),
        (7, LONG, "c"), (8, "word", "c"), (9, "word", "c"), (None, PROSE, "a"), (None, None, None), (10, "\x0b\x85 é " * 60, "z")]
    return spark.createDataFrame([(i, t, s, None, 7, 1, "x", "k", 3, "s", 9, "w") for i, t, s in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    """{doc_id: (set size, least id reachable)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def plain_repeats(rows, length=100):
    """{doc_id: (bytes, removed, spans, kept)} from a set of all earlier windows."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
