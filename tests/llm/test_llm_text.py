"""Quality, language-model scores, personal data, licences and page text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import PROSE, messy, words

from barloom.llm import context_mixing, licences, main_text, quality, sanitise

SMALL = "/root/testdata/sf0.001"


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 50 and right >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_messy_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 5, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(messy(spark), odd).collect()
    assert len(got) == 13 and len({r.score for r in got}) == 1  # nothing to learn from
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(messy(spark).select("doc_id", "text"))
    scores = [r.score for r in quality.quality_scores(rows, labels).collect()]
    assert len(scores) == rows.count() and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(messy(spark), labels).columns == messy(spark).columns
    assert quality.quality_scores(messy(spark, []), labels).count() == 0


def test_discriminant_is_the_formula():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(400, d)), rng.normal(1.0, 2.0, size=(500, d))]
    sums = np.concatenate([np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)]) for z in x])
    model = quality.Discriminant(sums)
    cov = [np.cov(z.T, bias=True) for z in x]
    pooled = (400 * cov[0] + 500 * cov[1]) / 900
    pooled = (1 - quality.TO_DIAGONAL) * pooled + quality.TO_DIAGONAL * np.diag(np.diag(pooled))
    t = rng.normal(size=d)
    log = []
    for z, c in zip(x, cov, strict=True):
        c = (1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled + quality.FLOOR * np.eye(d)
        r = t - z.mean(axis=0)
        log.append(-0.5 * (r @ np.linalg.solve(c, r) + np.linalg.slogdet(c)[1]))
    assert math.isclose(model.scores(t[None])[0], 1 / (1 + math.exp(log[0] - log[1] - math.log(5 / 4))), rel_tol=1e-6)


def plain_base(rows):
    tok = lambda t: [*words(t), None]
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(tok(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (len(w := tok(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, t in rows}


def test_base_scores_match_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    got = context_mixing.score_texts(docs).collect()
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
    bits = [r for r in got if r.held_out]
    assert sum(r.score for r in bits) / -math.log10(2) / sum(r.n_bytes for r in bits) < 4  # 8 without a model


def test_probabilities_of_a_byte_sum_to_one():
    rng = np.random.default_rng(4)
    tables = context_mixing.Tables(rng.integers(0, 50, (1 << b, 2)).astype(np.uint16) for b in context_mixing.SLOT_BITS)
    model = context_mixing.Model(tables)
    model.map = rng.uniform(0.01, 0.99, len(model.weights) * context_mixing.LEVELS)
    for context in rng.integers(0, 1 << 40, 5):
        bits = model.bits((np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert math.isclose((2.0 ** -bits).sum(), 1, rel_tol=1e-6)


def test_grams_end_texts():
    data = np.frombuffer(b"abc", np.uint8)
    gram, at = context_mixing.grams(data, np.array([0, 2, 2, 3]))
    assert at.tolist() == [0, 3, 4, 6]
    assert [int(g).to_bytes(6, "big") for g in gram] == [b"\0\0\0\0\0a", b"\0\0\0\0ab", b"\0\0\0ab\xff", b"\0\0\0\0\0\xff", b"\0\0\0\0\0c", b"\0\0\0\0c\xff"]


def test_scores_of_messy_rows(spark):
    got = context_mixing.score_texts(messy(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    want = plain_base([(i, {4: None, 5: "", 8: "word"}[i]) for i in (4, 5, 8)])
    assert sorted(by) == list(range(1, 11)) and [by[i].n_tokens for i in (4, 5, 6, 8)] == [want[4][0], 1, 1, want[8][0]]
    assert by[5].bits_per_byte is None and by[4].score == by[5].score
    assert all(r.held_out for r in got if r.doc_id is None)
    assert context_mixing.score_texts(messy(spark, [])).count() == 0
    only = context_mixing.score_texts(messy(spark, [(i, "a b", "s") for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0])).collect()
    assert only and {(r.train_tokens, r.n_known, r.base_score) for r in only} == {(0, 0, 0.0)}


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (_, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, lambda: all(int(x) <= 255 for x in m.group().split(".")), lambda: 14 <= len(digits) <= 19 and sanitise.luhn(digits),
                  lambda: 10 <= len(digits) <= 15)[k]
            if ok is True or ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c_d@e.f", "a@@b.c x.y@z a@b..c", "é a.b@c-d.e-f.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112",
          "+1 (555) 010-9999 +44 20 7946 0958x +12", "4111111111111111@mail.example.com", "", "0" * 40, "1.1.1." + "9" * 30, "+1" + "." * 50 + "2345678901"]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert sanitise.base_spans(text) == plain_spans(text)


def test_terms_that_reveal_a_value(spark):
    rows = [(i, f"please ask zanzibar about it or write to kim@example.com number {i} of the list", "s") for i in range(5)]
    rows += [(100 + i, f"please write about the list or ask {i} of it to number the rest", "s") for i in range(60)]
    got = {r.doc_id: r for r in sanitise.personal_data(messy(spark, rows)).collect()}
    assert got[0].n_email == 1 and got[0].n_terms == 1
    at = rows[0][1].index("zanzibar")
    assert got[0].spans.split(",")[0] == f"term_removed:{at}:{at + 8}"
    mail = rows[0][1].index("kim")
    assert got[0].base_sha256 == hashlib.sha256(f"email:{mail}:{mail + 15}".encode()).hexdigest()
    assert got[100].spans == "" and got[100].n_terms == 0
    clean = {r.doc_id: r.text for r in sanitise.sanitised(messy(spark, rows)).collect()}
    assert clean[0] == "please ask  about it or write to [email] number 0 of the list" and clean[100] == rows[5][1]


def test_terms_go_wherever_they_stand(spark):
    rest = " and so on with the list" * 4
    rows = [(i, f"please ask zanzibar about it or write to kim@example.com number {i} of the list{rest} é Zanzibar{', li' if i == 0 else ''}", "s") for i in range(5)]
    rows += [(10 + i, f"li writes to lee@example.com of the list {i}", "s") for i in range(5)]
    rows += [(20, f"the list of ZANZIBAR{rest}", "s")]
    rows += [(30 + i, f"call +1 555 010 9999 {'x' * 200} {'y' * 200} yokohama{i % 2} now", "s") for i in range(10)]
    rows += [(100 + i, f"please write about the list or ask {i} of it to number the rest and call so on now with writes", "s") for i in range(60)]
    got = {r.doc_id: r for r in sanitise.personal_data(messy(spark, rows)).collect()}

    def spans(i):
        text = rows[[r[0] for r in rows].index(i)][1]
        return [text[int(s):int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x) if k.startswith("term")]
    assert spans(0) == ["zanzibar", "Zanzibar", "li"] and spans(20) == ["ZANZIBAR"] and spans(10) == ["li"]
    assert {"yokohama0"} < set(spans(30)) and got[100].spans == ""
    clean = {r.doc_id: r.text for r in sanitise.sanitised(messy(spark, rows)).collect()}
    assert not any("zanzibar" in t.lower() for t in clean.values()) and "yokohama" not in clean[30] + clean[31]


def test_personal_data_of_messy_rows(spark):
    rows = [(1, "x@y.zz", "a"), (1, "x@y.zz", "a"), (None, "x@y.zz", None), (2, None, "a"), (3, "", "a"), (4, "x@y.zz " * 3000, "a")]
    got = sorted(((r.doc_id or 0), r.n_email) for r in sanitise.personal_data(messy(spark, rows)).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 3000)]
    out = sanitise.sanitised(messy(spark, rows))
    assert out.columns == messy(spark).columns
    assert Counter(r.text for r in out.collect() if r.doc_id != 4) == {"[email]": 3, None: 1, "": 1}
    assert sanitise.personal_data(messy(spark, [])).count() == 0 and sanitise.sanitised(messy(spark, [])).count() == 0


def test_licences(spark):
    rows = [(1, "intro\nReleased under the MIT License.\nend", "a"), (2, "Licensed under the Apache License, Version 2.0.", "a"),
            (3, "This work is licensed under the GNU General Public License, version 3.", "a"), (4, "Licensed under CC BY-NC 4.0.", "a"),
            (5, "His driver's license was taken away, which warrants a fine.", "a"), (6, PROSE, "a"), (7, None, "a"), (8, "", "a"),
            (9, "All rights reserved.", None), (None, "Released under the MIT License.", "a"), (1, "intro\nReleased under the MIT License.\nend", "a"),
            (10, "word " * 50000 + "\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "a")]
    got = licences.scan(messy(spark, rows)).collect()
    found = Counter((r.doc_id, r.line, r.family, r.confirmed) for r in got)
    assert found == {(1, 2, "mit", True): 2, (2, 1, "apache", True): 1, (3, 1, "gpl", True): 1, (4, 1, "cc-by-nc", True): 1, (5, 1, "unknown", False): 1,
                     (9, 1, "proprietary", True): 1, (None, 1, "mit", True): 1, (10, 2, "gpl", True): 1}
    assert "Python" not in licences.scan(messy(spark, rows))._jdf.queryExecution().toString()
    assert licences.scan(messy(spark, [])).count() == 0


PAGES = [
    ("<article>a<br>b &amp c<p>one <b>two<p>three<ul><li>l1<li>l2</ul><table><tr><td>x<td>y<tr><td>z</table><aside>no</aside>"
     "<div class='reader-comments'>c</div></article>", "a b & c\none two\nthree\nl1\nl2\nx y\nz"),
    ("<nav>m</nav><header>h</header><main><h1>T</h1><p>x  y\n z</p><form><p>f</p></form></main><footer>f</footer>", "T\nx y z"),
    ("plain <i>text</i> &lt;b&gt; 1 < 2", "plain text <b> 1 < 2"), ("", ""), ("<script>if (a < b) document.write('<p>x</p>')</script>", ""),
    ("<p>a<!-- <p>no</p> -->b</p><p title='>'>c</p><p", "ab\nc"), ("<article><header><h1>T</h1></header>x<div class=ad>y</div></article><p>out</p>", "T\nx")]


@pytest.mark.parametrize("html,text", PAGES)
def test_page_text(html, text):
    assert main_text.Page(html).text() == text


def test_site_templates(spark):
    rows = [(i, f"http://A.example.com:80/p/{i}", f"<article><p>Own text {i}</p><p>Follow us everywhere</p></article>", "x") for i in range(20)]
    rows += [(100 + i, "http://b.example.com/", "<article><p>Copied page</p></article>", "x") for i in range(20)]
    rows += [(200 + i, f"http://c.example.com/{i}", f"<article><p>Own {i}</p><p>Follow us everywhere</p></article>", "x") for i in range(5)]
    rows += [(300 + i, "http://d.example.com/", f"<article><p>Two {i}</p><p>Shared by both</p></article>", "x") for i in range(2)]
    rows += [(400 + i, "http://e.example.com/", f"<article><p>Page {i}</p><p>{'On half' if i < 3 else f'Own {i}'}</p><p>{'On fewer' if i < 2 else f'Else {i}'}</p></article>", "x") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert got[3] == "Own text 3" and got[103] == "Copied page" and got[203] == "Own 3" and got[301] == "Two 1\nShared by both"
    assert got[400] == "Page 0\nOn fewer" and got[402] == "Page 2\nElse 2" and got[404] == "Page 4\nOwn 4\nElse 4"


def test_messy_pages(spark):
    rows = [(1, None, None, 1), (None, "x", "<p>a", 1), (2, "http://h/", "", 1), (2, "http://h/", "", 1), (3, "http://h/", "<p>w " * 30000, 1), (4, "http://u:p@H/", "<" * 5000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, subtrees int")
    got = sorted(((r.page_id or 0), r.n_chars) for r in main_text.main_text(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 59999), (4, 5000)]
    assert main_text.main_text(df.limit(0)).count() == 0
