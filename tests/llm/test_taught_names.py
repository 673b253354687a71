from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm import personal

FAMILIES = ("Fenby", "Ockmoor", "Tarnley", "Wexcroft", "Halworth")


def items_of(spark, folder, lines, listed=("Linus",)):
    spark.createDataFrame(list(enumerate(lines)), "note_id long, content string").write.parquet(f"{folder}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{folder}/turns.parquet")
    spark.createDataFrame([(x,) for x in listed], "given_name string").write.parquet(f"{folder}/given_names.parquet")
    return {(r.rec_id, r.item) for r in personal.found(spark, str(folder)).where("pii_type = 'name'").collect()}


def test_learned_names_are_looked_for_in_one_case(spark, tmp_path):
    lines = [f"Spoke with {g} {f} about plans. Call 07700 900832 and ask for {g} {f}." for g in ("Linus", "Una", "Maud") for f in FAMILIES] * 3
    lines += [f"Spoke with {g} {f} about plans." for g, f in zip(("Agda", "Brunhild", "Cosima", "Dorthe", "Egon", "Falk", "Gitta", "Hauke", "Ilka", "Jorn", "Kunz", "Lale", "Malte", "Nele", "Ortrud"), FAMILIES * 3)]
    cases = {"Yesterday we spoke with yorrik tarnley again.": "yorriktarnley", "Signed, yorrik halworth.": "yorrikhalworth", "Signed, una drystone.": "unadrystone", "Reviewed by YORRIK OCKMOOR.": "yorrikockmoor"}
    got = items_of(spark, tmp_path, [*lines, *cases, "They met later, plain words here. NOTE THAT and so on."])
    assert {(len(lines) + i, x) for i, x in enumerate(cases.values())} <= got
    assert {x for i, x in got if i >= len(lines)} == set(cases.values())


def test_rare_names_are_learned_on_large_input(spark):
    def span(i, votes, given, family, left):
        text = {"rec_type": F.lit("note"), "rec_id": i.cast("long"), "text_hash": i.cast("long"), "item": F.lit(given + family), "votes": F.lit(votes), "given": F.lit(given), "family": F.lit(family), "left": F.lit(left), "right": F.lit(". x")}
        columns = {**text, "kind": F.lit(4), "start": F.lit(0), "end": F.lit(9), "near": i.cast("long"), "middle": F.lit(False)}
        return [columns[c].alias(c) for c in (*personal.KEY, *(x.split(" ")[0] for x in personal.SPAN.split(", ")))]

    many = spark.range(200_000).select(*span(F.col("id"), "211111", "linus", "fenby", "signed ,"))
    mixed = spark.range(20).select(*span(300_000 + F.col("id"), "111111", "hauke", "fenby", "")).union(spark.range(400).select(*span(400_000 + F.col("id"), "010101", "open", "questions", "# #")))
    rare = [spark.range(2).select(*span(500_000 + 10 * i + F.col("id"), "211111", given, "drystone", "signed ,")) for i, given in enumerate(("linus", "una", "hauke"))]
    rows = spark.createDataFrame([("note", 600_000, 1, "Reviewed by yorrik drystone, they wrote.")], "rec_type string, rec_id long, text_hash long, content string")
    got = personal.accept(reduce(DataFrame.union, [many, mixed, *rare]), rows, {"linus"}).where("rec_id = 600000").collect()
    assert [s.item for r in got for s in r.spans] == ["yorrikdrystone"]


def test_filter_has_every_name(spark):
    names = ["fenby", "møller", "a" * 300, *(f"name{i}" for i in range(5000))]
    bits = personal.filter_of(spark.createDataFrame([(x,) for x in names], "given string"))
    look = personal._second_look(spark, bits, bits)
    assert all(len(list(look(f"x {n} drystone"))) == 1 for n in ("fenby", "møller")) and not list(look("x plain drystone"))
    assert 5000 <= sum(int(x).bit_count() for x in bits) <= 5003


def test_votes_are_the_same_in_both_joins(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"name{i % 50}" if i % 3 else "") for i in range(600)], "id long, given string")
    known = spark.createDataFrame([(f"name{i}", "2") for i in range(0, 50, 2)], "given string, vote string")
    for hot in (50_000, 0, 50):
        monkeypatch.setattr(personal, "HOT", hot)
        got = personal.voted(rows, {"given": known}, "id").collect()
        assert sorted((r.id, r.given_vote) for r in got) == [(i, "2" if i % 3 and i % 50 % 2 == 0 else None) for i in range(600)]


def test_ordinary_words_arent_names_in_one_case(spark, tmp_path):
    lines = [f"Spoke with {g} {f} about plans. Call 07700 900832 and ask for {g} {f}." for g in ("Linus", "Una", "Maud") for f in (*FAMILIES, "Para")] * 3
    words = [f"Monday carpeta para todos, visita para {i}. Met folder para him." for i in range(100)]
    assert not [x for i, x in items_of(spark, tmp_path, [*lines, *words]) if i >= len(lines)]


GIVEN = ("Alda", "Bertram", "Corin", "Delphine", "Kendra", "Linus", "Neville", "Percy", "Sybil", "Verity", "Imogen", "Hollis", "Orla")
#: Listed are the first ten; frames stand in none of the word lists.
FRAMES = ("The minutes were approved by {} yesterday", "A parcel from {} got lost", "Nobody told {} why", "My cousin {} kayaks well")


def framed():
    people = [f"{g} {f}" for i, g in enumerate(GIVEN) for f in FAMILIES[i % 2 :: 2]]
    lines = [frame.format(p) + f", item {i}." for i, frame in enumerate(FRAMES) for p in people]
    return lines + [f"Then the Rose Garden plan {i} and a Port Ellmere trip {i} came up." for i in range(40)]


def test_cues_are_learned_from_other_frames(spark, tmp_path):
    lines = [*framed(), "Nobody told Wiebke Ockmoor why.", "The minutes were approved by orla fenby yesterday.", "A parcel from Quentin Drystone got lost."]
    got = items_of(spark, tmp_path, lines, GIVEN[:10])
    n = len(framed())
    assert {(n, "wiebkeockmoor"), (n + 1, "orlafenby"), (n + 2, "quentindrystone")} <= got
    assert not {x for _, x in got if "garden" in x or "ellmere" in x}
    assert {x for _, x in got} >= {f"{g}{f}".lower() for i, g in enumerate(GIVEN) for f in FAMILIES[i % 2 :: 2]}


def test_copies_change_nothing(spark, tmp_path):
    lines = [*framed(), "una promesa con Una Promesa", "Sache Eintrag zu", "Nobody told Wiebke Ockmoor why.", "orla fenby left"]
    (tmp_path / "one").mkdir()
    (tmp_path / "ten").mkdir()
    once = items_of(spark, tmp_path / "one", lines, (*GIVEN[:10], "Una"))
    ten = items_of(spark, tmp_path / "ten", lines * 10, (*GIVEN[:10], "Una"))
    assert ten == {(i + k * len(lines), x) for i, x in once for k in range(10)}


def test_contents_of_one_key_keep_their_own_spans(spark, tmp_path):
    notes = [(1, "Write to a.b@example.org or call it a day."), (1, "A longer text before, then c.d@example.org, and on.")]
    spark.createDataFrame(notes, "note_id long, content string").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame([("Linus",)], "given_name string").write.parquet(f"{tmp_path}/given_names.parquet")
    assert {r.content for r in personal.redacted(spark, str(tmp_path)).collect()} == {"Write to [EMAIL] or call it a day.", "A longer text before, then [EMAIL], and on."}
