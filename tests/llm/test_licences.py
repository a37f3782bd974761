"""op5: the trained classifier on held-out wordings, and whole texts."""
import pytest
from hostile import LONG, empty, hostile

from sheaf.llm import licences
from sheaf.llm.common import ship

FOUND = [
    (700, "first line\nLicensed under the Apache License, Version 2.0.\nlast line", "apache-2.0"),
    (701, "Released under the MIT License.", "mit"),
    (702, "This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    (703, "words before\n\nLicensed under CC BY-NC 4.0.", "cc-by-nc"),
    (704, "RELEASED UNDER THE MIT LICENSE.\nlicensed under cc by-nc 4.0", "cc-by-nc,mit"),
    (705, "the author was released under a bridge in version 2 of the story", ""),
    (706, "a text on licences in general, which names none of them", ""),
    (707, "some words, then: this code is licensed under the Mozilla Public License, version 2.0 and more words", "mpl-2.0"),
    (708, "long " * 30000 + "\nReleased under the MIT License.", "mit"),
]
CORPUS = [(800 + i, "\n".join(f"plain words {i} of no licence kind {k} at all, the and of to" for k in range(5)).replace("licence", "special")) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return hostile(spark, [(i, t) for i, t, _ in FOUND] + [(701, FOUND[1][1])] + CORPUS)


def test_query(docs):
    rows = licences.op5(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.licences for r in rows if r.doc_id is not None and 700 <= r.doc_id < 800}
    assert got == {i: f for i, _, f in FOUND}
    assert all(r.n_paragraphs == r.n_confirmed == 1 for r in rows if r.doc_id == 701) and sum(r.doc_id == 701 for r in rows) == 2
    assert all(r.licences == "" and r.n_paragraphs == 0 for r in rows if r.doc_id is None or r.doc_id < 700 or r.doc_id >= 800)


def test_held_back_rows_are_told_apart(spark, docs):
    model = licences.fit(docs)
    assert model["temperature"] in licences.TEMPERATURES and model["classes"][0] == licences.UNKNOWN
    rows = licences.literal_rows(spark, [{"id": i, "text": n["notice"].replace("Licensed", "licensed")} for i, n in enumerate(licences.notices())],
                                 "id int, text string")
    got = {r.id: r.licences for r in licences.scan(rows, model, "id").collect()}
    right = [got[i] == n["family"] for i, n in enumerate(licences.notices())]
    assert sum(right) / len(right) > 0.95


def test_empty_table(spark):
    assert licences.op5(empty(spark)).count() == 0


def test_no_python_in_the_plan(docs):
    plan = licences.op5(docs)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Pandas" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
TEXTS = [(0, "MIT License", "mit"), (1, "The MIT License (MIT)", "mit"), (2, MIT, "mit"), (3, BSD, "bsd"),
         (4, f"some words\n\nThe MIT License (MIT)\n \n{MIT}\n\n\n\nmore words\n\n{BSD}", "bsd,mit"),
         (5, "Mozilla Public License Version 2.0", "mpl-2.0"), (6, "This work is licensed\nunder CC BY-SA 4.0.", "cc-by-sa"),
         (7, "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "gpl-3"), (8, "permission was granted, and free of charge", "")]


def test_licence_texts(spark, docs):
    model = licences.fit(docs)
    rows = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc_id int, text string")
    got = {r.id: r for r in licences.scan(rows, model).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: f for i, _, f in TEXTS}
    assert got[4].n_paragraphs == got[4].n_confirmed == 3 and got[2].n_paragraphs == 1


def test_sampled_paragraphs_are_whole(docs):
    got = {r.line for r in licences.sampled(docs).collect()}
    assert LONG in got and "x" * 70000 in got


def test_words_of_a_line_are_made_once(spark, docs):
    """A word outside the model is looked up in no table, and the n-grams of a hit are made once,
    not for every template."""
    got = {r.line: r.w for r in licences.in_words(
        spark.createDataFrame([(1, "The MIT\n--\nzq license\n \nalone")], "id int, text string"), ["alone", "license", "mit", "the"]).collect()}
    assert got == {"The MIT\n--\nzq license": ["the", "mit", None, "license"], "The MIT": ["the", "mit"], "zq license": [None, "license"],
                   "alone": ["alone"]}
    model = licences.fit(docs)
    plan = licences.classify(docs.select("doc_id", "text"), model, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("LocalRelation")[0].count("array_distinct(") <= 2 and "INSET" in plan


def test_names_in_lines_and_paragraphs(spark):
    text = "plain words\nthe Mit of old\ncommit it\n\nlicen\ncs\n\nits cc0"
    rows = spark.createDataFrame([(text,)], "text string")
    assert {r.line for r in licences.sampled(rows).collect()} == {"plain words", "commit it", "licen\ncs", "licen", "cs"}
