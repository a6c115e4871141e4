"""Tokenizers, packing, extraction, licences and toxicity against the libraries or planted cases."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from larkfield.llm import bpe, html_extract, licenses, packing, token_counts, toxicity

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, part string, ids string, at string"  # extra columns with names used inside
HARD = ["", None, "Hello  World's\n\nit's 12a_b--__", "x <|endoftext|>y<|startoftext|>", "ΣΑΣ Ünï é 日本語 ½ ² \x1c \x85", "aaaa" * 3000, "***" * 900, "ab" * 2500, "▁a ▁▁ b   c", " lead and trail ", "\ttab\r\n", "<s></s><unk>", "the cat " * 4000, "​é́x", "the cat " * 4000]


def rows(texts):
    return [(i, t, "p", "q", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(3)
    return ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x250), rng.randrange(0x20, 0x3000)])) for _ in range(rng.randrange(300))) for _ in range(60)]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, noise):
    texts = HARD + noise
    got = {r.doc_id: r for r in bpe.encode_table(spark.createDataFrame(rows(texts), DOCS), WORD).collect()}
    digest = {r.doc_id: r for r in bpe.encode_table(spark.createDataFrame(rows(texts), DOCS), WORD, emit="digest").collect()}
    t = library()
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i].decoded == decoded
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_table(spark.createDataFrame([], DOCS), WORD).count() == 0


def test_bpe_forgets_words_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    e, t = bpe.WordBpe(WORD), library()
    for text in ["one two three four", "five <|endoftext|> six", "one two"]:
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark, noise):
    import sentencepiece

    texts = HARD + noise
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(rows(texts), DOCS), PIECE, limit=100).collect()}
    for i, text in enumerate(texts):
        n = len(sp.encode(text or ""))
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 100, len((text or "").encode()))
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PIECE).count() == 0


def test_packing_is_gapless_and_whole(spark, noise):
    texts = HARD + noise
    df = spark.createDataFrame(rows(texts), DOCS).repartition(3)
    got = packing.pack(df, WORD, window=256, with_ids=True).orderBy("sequence_id", "offset").collect()
    t, docs, at = library(), {}, 0
    for r in got:
        assert (r.sequence_id, r.offset) == divmod(at, 256) and r.offset + r.length <= 256
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        docs.setdefault(r.doc_id, []).append(r)
        at += r.length
    for i, text in enumerate(texts):
        pieces = sorted(docs[i], key=lambda r: r.start)
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in pieces for x in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert pieces[0].opens and pieces[-1].closes
    assert packing.pack(spark.createDataFrame([], DOCS), WORD).count() == 0


PROSE = "The cat sat on the mat and it was in the house with all of the people that were there for this."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{PROSE}<br>Short.<p>a  &lt;b&gt;\n c</article><footer>the and of</footer>", f"Title {PROSE} Short. a <b> c"),
        (f'<script>var t="</p>";</script><!-- x --><div class="ad">{PROSE}</div><article><p>{PROSE}</p></article>', PROSE),
        (f"<div id=main><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div class=sidebar>x</div><form><p>{PROSE}</p></form>", f"{PROSE} Short one. {PROSE}"),
        (f'<article><p>{PROSE}</p><section class="comments"><p>{PROSE}</p></section></article>', PROSE),
        *((f'<div class="{c}"><p>{PROSE}</p><p>{PROSE}</p></div>', f"{PROSE} {PROSE}") for c in ("content has-sidebar", "post no-comments", "layout-with-header", "story search-result", "entry-content share-enabled")),
        *((f'<p>{PROSE}</p><div class="{c}"><p>{PROSE}</p></div>', PROSE) for c in ("site-footer", "x sidebar", "postComments", "related-posts", "cookie-banner")),
        (f"<main><a href=x>Go to the start of it</a></main><p>{PROSE}</p><p>{PROSE}</p>", f"{PROSE} {PROSE}"),
        (f"<p>{PROSE}</p><a href=\"x class='y>one</a><p>{PROSE} it's</p>", f"{PROSE} {PROSE} it's"),
        (f"<article><p>{PROSE}</p><p>Short.</p><ul><li><a href=x>one two</a><li><a href=y>three four</a></ul><p>Of the list.</p></article>", f"{PROSE} Short."),
        (f"<ul><li class=ad>{PROSE}<li>{PROSE}</ul><p>a < b <c", f"{PROSE} a < b"),
        (f"<p hidden>{PROSE}</p><p>{PROSE}</p><p><a href=a>one two three</a> <a href=b>four five six seven</a></p>", PROSE),
    ],
)
def test_extraction(page, text):
    assert html_extract.extract(page) == text


HOSTILE = {
    "quotes": "<a title='" * 100000, "inline": "<b>" * 100000 + "</i>" * 200000, "blocks": "<div>" * 80000 + "</section>" * 80000, "crossed": "<b>" * 80000 + "<div>" * 80000 + "</b>" * 80000, "less": "<" * 1000000,
    "comments": "<!--" * 250000, "scripts": "<script>" * 120000, "class": '<div class="' + "a-" * 500000 + '">', "spaces": "<a" + " " * 1000000 + ">x", "paragraphs": "<p>x</p>" * 120000, "mixed": "<a x='y>\"z " * 90000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_extraction_is_linear(name):
    began = time.thread_time()
    html_extract.extract(HOSTILE[name])
    assert time.thread_time() - began < 3  # a third of it on a quiet machine; quadratic work takes minutes


class Plain(HTMLParser):
    """Blocks of a well-formed page, by its tree: a stack of elements, asked afresh for each text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.now, self.out = [], [], []

    def cut(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            linked = " ".join("".join(t for t, a in self.now if a).split())
            self.out.append((text, len(linked), any(html_extract._marked(a)[0] and n not in ("body", "article", "main") or n in html_extract.DROPPED for n, a in self.path), any(n in html_extract.MAIN for n, _ in self.path)))
        self.now = []

    def handle_starttag(self, name, attributes):
        marks = " ".join(f'{k}="{v}"' for k, v in attributes)
        if name in html_extract.BLOCK or name in html_extract.DROPPED or html_extract._marked(marks)[0]:
            self.cut()
        if name not in html_extract.VOID:
            self.path.append((name, marks))

    def handle_endtag(self, name):
        if name in html_extract.BLOCK or name in html_extract.DROPPED or html_extract._marked(self.path[-1][1])[0]:
            self.cut()
        assert self.path.pop()[0] == name

    def handle_data(self, text):
        if not any(n in html_extract.RAW for n, _ in self.path):
            self.now.append((text, any(n == "a" for n, _ in self.path)))


def plain_labels(found):
    """The second pass, each block with all others."""
    first = [html_extract.decide(*b) for b in found]
    weight = lambda inside: sum(len(b[0]) for b, x in zip(found, first) if x == 1 and b[3] == inside)
    trusted = any(b[3] and not b[2] for b in found) and weight(True) >= weight(False)
    own = [i for i, b in enumerate(found) if not b[2] and (b[3] or not trusted)]
    out = []
    for i in range(len(found)):
        if i not in own:
            out.append(-1)
        elif first[i]:
            out.append(first[i])
        else:
            decided = [(abs(own.index(j) - own.index(i)), -first[j]) for j in own if first[j]]
            out.append(-min(decided)[1] if decided else 1)
    return out


def some_page(rng):
    inner = [f"<p>{PROSE}</p>", "<h2>A heading</h2>", "<p>Short one.</p>", "<ul><li><a href='x'>one two</a></li><li><a href='y'>three &amp; four</a></li></ul>", f"<p><b>{PROSE}</b><br>after it</p>", f"<div class='sidebar'><p>{PROSE}</p></div>", f"<blockquote>{'zzz ' * 80}</blockquote>", "<p>none of these have a link <a href='z'>in it</a> but one of them</p>", "<script>var x = '<p>';</script>"]
    body = lambda: "\n".join(rng.choice(inner) for _ in range(rng.randrange(7)))
    return f"<html><body><nav><a href='/'>Home</a></nav>{body()}" + (f"<article>{body()}</article>" if rng.random() < 0.6 else "") + f"<div>{body()}</div><footer>{PROSE}</footer></body></html>"


def test_extraction_equals_a_plain_version(spark):
    rng = random.Random(8)
    pages = [some_page(rng) for _ in range(400)]
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.cut()
        assert html_extract.blocks(page) == plain.out
        assert html_extract.extract(page) == " ".join(b[0] for b, x in zip(plain.out, plain_labels(plain.out)) if x > 0)
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():  # all of it, the article's blocks are its text
        assert html_extract.labels(html_extract.blocks(row.html)) == plain_labels(html_extract.blocks(row.html))


def test_extraction_table(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>"
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, long, "x"), (2, None, long, "x")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract_pages(df).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 3000 * len(PROSE) + 2999), (2, 3000 * len(PROSE) + 2999)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_licences(spark):
    texts = ["foo\nReleased under the MIT License.\nbar", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "He needs a license to drive.", None, "", "plain " * 20000, f"{PROSE} Licensed under the BSD 3-Clause License. {PROSE}"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id bigint, text string, family string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: r.licences for r in got} == {0: "MIT", 1: "CC-BY-NC", 2: "Apache-2.0, Proprietary", 3: "", 4: "", 5: "", 6: "", 7: "BSD"}
    assert {r.n_unknown for r in got if r.doc_id == 3} == {1}
    assert licenses.scan(df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got["predicted"] == (got["score"] >= 0.7)).all()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit >= 0.7 * (got["toxic"] == 1).sum() and ((got["predicted"] == 1) & (got["toxic"] == 0)).sum() <= 0.03 * len(got)
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()


def test_toxicity_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "x " * 50000, 9.0), (2, "", 9.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    kept = docs.where(toxicity.score_of(docs, toxicity.Model()) < 0.7)
    assert kept.columns == docs.columns and kept.agg(F.sum("score")).first()[0] == 36.0


def test_toxicity_equals_scoring_text_by_text(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    kernels = {w: model.conv[w] for w in toxicity.WIDTHS}
    for doc in docs.collect():  # each word's rows summed, each window's product, the greatest of each filter
        words = toxicity.WORD.findall((doc.text or "").lower())
        x = np.array([model.embed[model.features(w)].sum(0) for w in words]).reshape(len(words), model.dim)
        pooled = [max((sum(x[i + k] @ kernels[w][k] for k in range(w))[f] + model.bias[w][f] for i in range(len(words) - w + 1)), default=0.0) for w in toxicity.WIDTHS for f in range(model.filters)] if len(words) < 150 else None
        if pooled:
            logit = np.maximum(pooled, 0) @ model.out + model.out_bias
            cut = model.thresholds.get(toxicity.language(words), model.thresholds[""])
            assert abs(got[doc.doc_id].score - 1 / (1 + np.exp(-(logit - cut + np.log(0.7 / 0.3))))) < 1e-4
        assert got[doc.doc_id].predicted == (got[doc.doc_id].score >= 0.7)


def test_toxicity_forgets_words_without_changing_scores(spark, monkeypatch):
    base = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model, texts = toxicity.fit(docs, labels), [r.text or "" for r in docs.collect()]
    want = model.score(texts)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 20)
    monkeypatch.setattr(toxicity, "SCORE_CHARS", 500)
    assert np.allclose(model.score(texts), want, atol=1e-5)


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_licences_wrapped_over_lines(spark):
    marked = lambda text, mark, end="\n": end.join(mark + line for line in text.split("\n"))
    wrapped = [("MIT", MIT_GRANT), ("BSD", BSD_TEXT), ("GPL", GPL_HEADER), ("ISC", ISC_TEXT), ("LGPL", GPL_HEADER.replace("GNU General", "GNU Lesser General"))]
    cases = [(family, f"int a;\n\n{form(text)}\n\n{PROSE}") for family, text in wrapped for form in (str, lambda t: "/*\n" + marked(t, " * ") + "\n */", lambda t: marked(t, "# ", "\r\n") + "\r\n#\r\n", lambda t: marked(t, "REM "), lambda t: marked(t, "// ") + "\nint main() { return 0; }")]
    cases += [("MIT, GPL", f"{GPL_HEADER}\n{MIT_GRANT}"), ("MIT", "\n".join(MIT_GRANT.split())), ("", MIT_GRANT.replace("\n", "\n\n")), ("", f"{PROSE}\n" * 300), ("", "\n" * 50000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(t for _, t in cases)), "doc_id bigint, text string")).collect()}
    assert [got[k].licences for k in range(len(cases))] == [family for family, _ in cases]
    assert {(r.n_lines, r.n_unknown) for r in got.values() if r.licences not in ("", "LGPL")} == {(1, 0), (2, 0)}
    lines = "Released under the MIT License.\nReleased under the MIT License.\nHe needs a license to drive."
    one = licenses.scan(spark.createDataFrame([(0, lines)], "doc_id bigint, text string")).first()
    assert (one.licences, one.n_lines, one.n_unknown) == ("MIT", 2, 1)  # a run adds nothing to what its lines state


def test_licences_without_trigger_words(spark):
    texts = ["Distributed under the GPL version 2.", "This project is released under the Apache 2.0 terms.", "Use of this source code is governed by a BSD-style", PROSE]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[k].n_lines + got[k].n_unknown for k in range(4)] == [1, 1, 1, 0]
    assert [got[k].licences for k in range(2)] == ["GPL", "Apache-2.0"]


def plain_scan(text, model):
    """One text's (families, lines, unknown lines), paragraph by paragraph."""
    classes, weights, bias, temperature = model
    templates = [(f, set(licenses._trigrams(s))) for f, ss in licenses.TEMPLATES.items() for s in ss]

    def odds(words):
        z = np.array([sum(weights[g][k] for g in licenses.ngrams(words) if g in weights) + bias[k] for k in range(len(classes))]) / temperature
        return z, np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def shares(words):
        own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}
        return [(len(own & every) / len(every), f, every) for f, every in templates]

    found, n, unknown = set(), 0, 0
    for run in re.split(r"\n(?:[^\w\n]|_)*\n", text or ""):
        lines, own, left = run.split("\n"), set(), 0
        for line in lines:
            words = licenses.tokens(line)
            if not any(g in weights for g in licenses.ngrams(words)):
                left += bool(re.search(licenses.TRIGGER, line))
                continue
            z, p = odds(words)
            best = classes[int(z.argmax())]
            held = {f: max(s for s, g, _ in shares(words) if g == f) for f in licenses.TEMPLATES}
            if best != "unknown" and p.max() >= 0.7 and held[best] >= 0.6:
                own.add(best)
                n += 1
            else:
                left += bool(re.search(licenses.TRIGGER, line)) or max(held.values()) >= 0.6
        across = set()
        if len(lines) > 1:
            words = licenses.tokens(re.sub(r"(?i)(?:^|\r?\n)(?:[^\w\n]|_)*(?:(?:rem|dnl|c)[ \t]+)?", " ", run))
            held = [x for x in shares(words) if x[0] >= 0.6]
            held = [x for x in held if not any(y[0] > x[0] and y[1] != x[1] and y[2] & x[2] for y in held)]
            z, _ = odds(words)
            across = {f for _, f, _ in held if 1 / (1 + np.exp(z[-1] - z[classes.index(f)])) >= 0.7} - own
        found |= own | across
        n += len(across)
        unknown += 0 if across else left
    return ", ".join(f for f in licenses.TEMPLATES if f in found), n, unknown


def test_licences_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng, sentences = random.Random(4), [s for ss in licenses.TEMPLATES.values() for s in ss] + licenses.DECOYS
    made = []
    for k in range(120):  # whole, cut, changed and wrapped statements between other lines
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(sentences).split()
            words = [w for w in words if rng.random() > rng.choice((0, 0, 0.15, 0.4))]
            parts.append(rng.choice(("\n", "\n# ", " "))[:3].join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)) if rng.random() < 0.4 else " ".join(words))
            parts.append(rng.choice(("", PROSE, "x = 1", "see the license")))
        made.append((-k - 1, "\n".join(parts)))
    both = docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    model = licenses.train_on(docs)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = {r.doc_id: (r.licences, r.n_lines, r.n_unknown) for r in licenses.scan(both, model=model).collect()}
    assert got == {k: plain_scan(t, model) for k, t in texts.items()}
    assert sum(bool(x[0]) for x in got.values()) > 50


def test_licences_of_repeated_and_null_ids(spark):
    rows = [(None, "Released under the MIT License."), (None, "Licensed under CC BY 4.0."), (3, "Released under the MIT License."), (3, "nothing here"), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.licences) for r in got), key=str) == sorted([(None, "MIT"), (None, "CC-BY"), (3, "MIT"), (3, ""), (None, "")], key=str)


def test_needed_words_are_necessary():
    rng, words = random.Random(2), set(licenses.needed_words())
    for sentence in (s for ss in licenses.TEMPLATES.values() for s in ss):
        all_words, grams = licenses.tokens(sentence), licenses._trigrams(sentence)
        for _ in range(300):  # any paragraph without one of them holds too little of the template
            kept = [w for w in all_words if w not in words and rng.random() < 0.95]
            assert len(licenses._trigrams(" ".join(kept)) & grams) / len(grams) < licenses.MIN_CONTAINED
        assert sum(not set(g.split()) & words for g in grams) / len(grams) < licenses.MIN_CONTAINED
