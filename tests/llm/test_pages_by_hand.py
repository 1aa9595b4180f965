"""Pages and notices that were written by hand, not by what trains the models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import html_extraction, licenses

BODY = (
    "The old mill stood at the bend of the river for three hundred years before anybody thought of turning it into a museum.",
    "Last spring the council voted to repair the wheel, and the first visitors came in June. They found the machinery almost complete, down to the leather belts.",
    "Most of the work was done by volunteers, who spent their weekends scraping rust from the gears and painting the beams.",
)
ARTICLE = "".join(f"<p>{x}</p>" for x in BODY)
WANT = "\n\n".join(["A mill comes back to life", *BODY])
PAGES = {
    "machine classes": f"<html><head><title>Mill - Daily</title></head><body><div class='css-1ab'><ul class='css-9zz'><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sports</a></li></ul></div><div class='css-77q'><div class='sc-x0'><h1>A mill comes back to life</h1>{ARTICLE}</div></div><div class='css-3kk'><p>© 2024 The Daily. All rights reserved.</p><a href='/p'>Privacy policy</a></div></body></html>",
    "no classes": f"<html><head><title>Mill</title></head><body><div><ul><li><a href='/'>Home</a></li><li><a href='/n'>About us</a></li><li><a href='/s'>Contact</a></li></ul></div><div><h1>A mill comes back to life</h1>{ARTICLE}</div><div><p>Copyright 2021 Example Inc. All rights reserved.</p></div></body></html>",
    "comments of another name": f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A mill comes back to life</h1>{ARTICLE}<section class='discussion'><h3>3 comments</h3><p>tom says:</p><p>Lovely, I went there last week.</p><p><a href='#'>Reply</a></p></section></article><footer><p>© 2024</p></footer></body></html>",
    "semantic tags": f"<html><body><header><p>The Daily</p></header><main><article><h1>A mill comes back to life</h1>{ARTICLE}</article></main><aside><h3>Most read</h3><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></aside><footer><p>Imprint</p></footer></body></html>",
    "usual names": f"<html><body><div class='navbar'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='cookie-banner'><p>We use cookies to improve this site</p></div><div class='entry-content'><h1>A mill comes back to life</h1>{ARTICLE}<div class='advert'><p>Buy now and save 50%</p></div></div><div class='sidebar'><h3>Related articles</h3></div></body></html>",
}


@pytest.mark.parametrize("name", PAGES)
def test_a_page_written_by_hand(name):
    page = html_extraction.blocks(PAGES[name])
    keep = html_extraction.label_pages(html_extraction.trained(), [page])[0]
    assert "\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k) == WANT


def texts(page):
    return [b.text for b in html_extraction.blocks(page)]


def test_elements_that_have_no_text_end_where_they_do():
    assert texts("<p>one <svg class='i'/> two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>a <svg><text>drawn</text></svg>b</p><p>c <math><mi>x</mi><mo>=</mo><mn>2</mn></math> d</p>") == ["a b", "c x=2 d"]
    assert texts("<p>open <svg> never closed</p><p>more</p>") == ["open never closed", "more"]
    assert texts("<p>a</p><select><option>one</option></select><textarea>two</textarea><iframe>three</iframe><p>b</p>") == ["a", "b"]
    assert texts("<p>shown <object data='x'>instead</object></p><noscript>without scripts</noscript><script>var a = '<p>x</p>'</script>") == ["shown instead", "without scripts"]
    assert texts("<svg>" * 300 + "<p>x</p>") == ["x"] and texts("<!-- never closed <p>x</p>") == []


def test_a_page_of_very_many_blocks_is_labelled_as_a_whole(monkeypatch):
    """In chunks of 7 or 700 blocks, whose directions go on from state to state, every block has the value that it has in one batch."""
    model = html_extraction.trained()
    page = html_extraction.blocks("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1>" + "".join(f"<p>{BODY[i % 3]} Part {i}.</p>" for i in range(2_000)) + "</article><footer><p>© 2024 All rights reserved</p></footer></body></html>")
    whole = html_extraction.label_pages(model, [page])[0]
    z = model.logits(model.vectors(page)[:, None, :], np.ones((len(page), 1), np.float32))[0][:, 0]
    for chunk in (7, 700):
        assert np.allclose(model.logits_of_long(page, chunk), z, atol=1e-3)
    monkeypatch.setattr(html_extraction, "BATCH_BLOCKS", 700)
    parts = html_extraction.label_pages(model, [page, [], page[:10]])
    assert (parts[0] == whole).all() and len(parts[1]) == 0 and len(parts[2]) == 10


def test_quotes_that_do_not_pair_end_with_their_tag():
    assert texts('<p title="a>hello</p><p>more</p>') == ["hello", "more"]
    assert texts("<p>one <a href=don't>two</a> it's</p><p>three's</p>") == ["one two it's", "three's"]
    assert texts('<p data-x="1"">four</p><p title="a > b" x=\'c > d\'>five</p>') == ["four", "five"]
    assert texts("<p " + 'a="1" ' * 5_000 + "<b>end</b>") == ["<p " + 'a="1" ' * 4_999 + 'a="1" end']


MIT = """MIT License

Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at"""
MPL = """-- This Source Code Form is subject to the terms of the Mozilla
-- Public License, v. 2.0. If a copy of the MPL was not distributed with
-- this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
PROSE = """The council may not use the hall except in winter, in compliance with the rules.
A copy of the plan is free of charge to any person who asks for it at the desk.
Her driving license was published in the general papers under the terms of the court.
The software industry granted permission to build without restriction on the hill."""
NOTICES = {"mit": MIT, "bsd": BSD, "gpl": GPL, "apache": APACHE, "mpl": MPL}


@pytest.fixture(scope="module")
def model(spark, docs):
    return licenses.Classifier(spark, docs)


def test_wrapped_notices_are_found(spark, model, tmp_path):
    """Headers as they stand in files, wrapped and behind comment marks, alone and between other lines; prose of the same words is none."""
    rows = [(i, x) for i, x in enumerate(NOTICES.values())]
    rows += [(10 + i, "import this\n\ncode = 1\n" + x + "\n\nmore code here\nand here") for i, x in enumerate(NOTICES.values())]
    rows += [(20, PROSE), (21, PROSE.replace("\n", " ")), (22, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in licenses.documents(spark.read.parquet(str(tmp_path / "d")), model).collect()}
    for i, family in enumerate(NOTICES):
        assert got[i].families == family and got[10 + i].families == family, (family, got[i], got[10 + i])
    assert got[20].n_licences == got[21].n_licences == got[22].n_licences == 0


def plain_paragraphs(text):
    lines = (text or "").split("\n")
    filled = [any(c.isalnum() for c in x) for x in lines]
    out = [(i, 1) for i, f in enumerate(filled) if f]
    short = [f and len(x) <= licenses.WRAPPED for f, x in zip(filled, lines, strict=True)]
    begin = 0
    while begin < len(lines):
        end = begin
        while end < len(lines) and short[end]:
            end += 1
        if end - begin > 1:
            k = begin
            while True:
                out.append((k, min(licenses.BLOCK, end - k)))
                if k + licenses.BLOCK >= end:
                    break
                k += licenses.BLOCK // 2
        begin = end + 1
    return sorted(out)


def test_paragraphs_are_lines_and_blocks(spark, docs, odd):
    many = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n)) + "\n\n" + "x" * 200 + "\nshort one\n# short two") for n in range(40)], "doc_id bigint, text string")
    for df in (docs, odd, many):
        rows = df.select(F.monotonically_increasing_id().alias("__row_id"), "text")
        got = {}
        for r in licenses.paragraphs(rows).collect():
            got.setdefault(r["__row_id"], []).append((r.position, r.n_lines))
        for r in rows.collect():
            assert sorted(got.get(r["__row_id"], [])) == plain_paragraphs(r.text)


def test_the_unknown_class_is_calibrated_on_the_corpus(spark, docs, nothing):
    prose = licenses.corpus_prose(docs).collect()
    assert 0 < len(prose) <= licenses.PROSE_LINES and licenses.corpus_prose(nothing).count() == 0
    held = {line for r in docs.collect() for line in (r.text or "").split("\n")}
    assert all(r.paragraph in held and "icens" not in r.paragraph for r in prose)


def test_held_out_texts_of_no_template(model, spark):
    """Sentences about licences and files that are no notice of any family."""
    texts = ["We sell licences for television sets.", "Copyright is a right of authors.", "Version 2.0 of the file is in the public folder.", "All warranties are void if the seal is broken.", "You may copy and modify the recipe free of charge.", "The foundation published a general report.", "Mozart in the public domain of music lovers.", "Anyone is permitted to walk here provided that the gate is shut."]
    got = model.predict(spark.createDataFrame([(x,) for x in texts], "paragraph string")).where("confirmed").collect()
    assert got == []


def test_labels_are_exact_on_named_pages_of_other_seeds():
    from shelfspark.llm.html_pages import Page

    model, seen = html_extraction.trained(), {}
    for seed in range(700_000, 700_300):
        page = Page(seed)
        style = page.style
        markup, labels = page.whole()
        found = html_extraction.blocks(markup)
        assert len(found) == len(labels)
        keep = html_extraction.label_pages(model, [found])[0]
        a, b = seen.get(style, (0, 0))
        seen[style] = (a + int((keep == np.array(labels, bool)).sum()), b + len(labels))
    assert all(a >= (0.99 if style == "named" else 0.95) * b for style, (a, b) in seen.items()), seen
