import re

import numpy as np
import pytest

from inkspark.llm import personal, subjects


def found_in(text, listed=("linus", "una")):
    return {(personal.TYPES[k], text[a:b]) for k, a, b, *_ in personal.spans(text, set(listed))}


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail a.b+c@mail.some.test now", "email", "a.b+c@mail.some.test"),
        ("write to kim7 [at] example [dot] org", "email", "kim7 [at] example [dot] org"),
        ("write to kim7 AT mail DOT example DOT org", "email", "kim7 AT mail DOT example DOT org"),
        ("[mail](mailto:x@y.example)", "email", "x@y.example"),
        ("Call +44 7700 900 540 before", "phone", "+44 7700 900 540"),
        ("ring (682) 555-0180 now", "phone", "(682) 555-0180"),
        ("new line 07700 900832 83 stocks", "phone", "07700 900832"),
        ("unter 030-23125050 erbeten", "phone", "030-23125050"),
        ("Appeler le 01 99 00 48 11 et", "phone", "01 99 00 48 11"),
        ("my SSN 957-23-4809 was", "id_number", "957-23-4809"),
        ("pide NIE X-0524528-M.", "id_number", "X-0524528-M"),
        ("NI number QQ 88 95 40 C in", "id_number", "QQ 88 95 40 C"),
        ("Deliver it at Flat 3, 16 Larkmoor Lane, Ashcombe", "address", "16 Larkmoor Lane"),
        ("wohnt jetzt Angerstraße 72, 01551", "address", "Angerstraße 72"),
        ("maintenant 161c rue des Cerisiers, 00160", "address", "161c rue des Cerisiers"),
        ("en Calle de los Curtidores 178, Torremura", "address", "Calle de los Curtidores 178"),
        ("Met Dr. Linus A. Fenby-Wexridge and talked", "name", "Linus A. Fenby-Wexridge"),
        ("paid by MARBY, Yvette.", "name", "MARBY, Yvette"),
    ],
)
def test_proposals(text, kind, span):
    assert (kind, span) in found_in(text)


@pytest.mark.parametrize("text, span", [("Signed, linus fenby.", "linus fenby"), ("Signed, L. FENBY.", "L. FENBY"), ("OHNE LINUS FENBY BLEIBT", "LINUS FENBY")])
def test_proposals_in_one_case(text, span):
    known = {"linus", "fenby"}.__contains__
    assert span in {text[a:b] for _, a, b, *_ in personal.one_case_spans(text, known, known)}


def test_em_trusts_good_labelers():
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.3
    votes = np.stack([np.where(rnd.random(4000) < a, truth, ~truth) * 2 for a in (0.95, 0.9, 0.55)], 1)
    q = personal.expectation_maximisation(votes, np.ones(4000))
    w = personal.logistic(votes, q, np.ones(4000))
    p = w[-1] + sum(w[3 * j + votes[:, j]] for j in range(3))
    assert ((p > 0) == truth).mean() > 0.9 and abs(w[3 * 2 + 2] - w[3 * 2]) < abs(w[2] - w[0])


def test_settle():
    s = [{"p": 0.9, "length": 5, "start": 0, "end": 5, "kind": 4, "item": "a"}, {"p": 0.8, "length": 6, "start": 3, "end": 9, "kind": 4, "item": "b"}, {"p": 0.7, "length": 2, "start": 9, "end": 11, "kind": 1, "item": "c"}]
    assert [x["item"] for x in personal.settle(s)] == ["a", "c"]


def test_whole(spark, tmp_path):
    people = [f"{g} {f}" for g in ("Linus", "Una", "Maud", "Edwin") for f in ("Fenby", "Ockmoor", "Tarnley", "Wexcroft", "Halworth")]
    lines = [f"Spoke with {p} about plans, reachable at {p.split()[0].lower()}{i}@example.org. Call 07700 9{i:05d} before noon and ask for {p}." for i, p in enumerate(people * 3)]
    lines += [f"The Rose Garden plan {i} is fine. Hash {100000000 + i} and build 20{i:02d}.1.2.3 passed." for i in range(60)]
    notes = [(i, t, "x") for i, t in enumerate(lines)] + [(1000, None, "x"), (1001, "", "x"), (1002, "Met Maud Tarnley and talked about it. " + "plain words " * 20000, "x"), (0, lines[0], "again")]
    spark.createDataFrame(notes, "note_id long, content string, item string").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame([("Linus", "en"), (None, None)], "given_name string, lang string").write.parquet(f"{tmp_path}/given_names.parquet")
    got = {(r.rec_id, r.pii_type, r.item) for r in personal.found(spark, str(tmp_path)).collect()}
    want = {(i, "name", p.replace(" ", "").lower()) for i, p in enumerate(people * 3)} | {(i, "phone", f"077009{i:05d}") for i in range(60)} | {(i, "email", f"{p.split()[0].lower()}{i}exampleorg") for i, p in enumerate(people * 3)}
    want.add((1002, "name", "maudtarnley"))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 3
    clean = {r.rec_id: r.content for r in personal.redacted(spark, str(tmp_path)).collect()}
    assert clean[0] == "Spoke with [NAME] about plans, reachable at [EMAIL]. Call [PHONE] before noon and ask for [NAME]." and clean[1001] == "" and 1000 not in clean
    assert re.sub(r"plan \d+", "", clean[100]) == re.sub(r"plan \d+", "", lines[100])


def test_subjects_agree_with_labels(spark, data):
    got: dict = {}
    for r in subjects.found(spark, data).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    labels: dict = {}
    for r in spark.read.parquet(f"{data}/subject_labels.parquet").collect():
        labels.setdefault(r.doc_id, set()).add(r.subject)
    assert len(got) > 50 and set().union(*got.values()) <= {r.subject for r in spark.read.parquet(f"{data}/subjects.parquet").collect()}
    assert sum(bool(got.get(d, set()) & s) for d, s in labels.items()) > 0.5 * len(labels)


def test_terms(spark):
    rows = spark.createDataFrame([("Alpha beta. Gamma!\n```\ncode\n```\n# Head\n| t |\n数据库和缓存。下一",), (None,)], "text string")
    got = rows.select(subjects.terms_of("text").alias("t")).collect()
    assert [x for x in got[0].t if x != "\n"] == ["alpha", "beta", "gamma", "数据", "据库", "库和", "和缓", "缓存", "下一"] and got[1].t is None
