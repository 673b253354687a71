import random

from inkspark.llm import neardup


def test_components(spark):
    rnd = random.Random(5)
    chain = list(range(0, 90))
    rnd.shuffle(chain)
    links = [*zip(chain, chain[1:]), *((200, x) for x in range(201, 240)), (300, 301), (301, 300), (400, 400)]
    got = {r.member: r.group for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 0 for x in range(90)} | {x: 200 for x in range(200, 240)} | {300: 300, 301: 300}


def test_groups_hold_what_links_connect(spark, tmp_path):
    rnd = random.Random(1)
    first = [f"w{rnd.randrange(900)}" for _ in range(120)]
    texts, now = {7: first}, first
    for i in (5, 9, 3):  # each differs from the one before by a few words, the last from the first by many
        now = [*now[6:], *(f"v{rnd.randrange(900)}" for _ in range(6))]
        texts[i] = now
    texts |= {20: first, 30: [f"u{rnd.randrange(900)}" for _ in range(60)]}
    spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "note_id long, content string").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([], "turn_id long, content string").write.parquet(f"{tmp_path}/turns.parquet")
    spark.createDataFrame([], "conv_id long, title string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.rec_id: (r.class_id, r.group_id) for r in neardup.classes(spark, str(tmp_path)).collect()}
    assert got == {7: (7, 3), 20: (7, 3), 5: (5, 3), 9: (9, 3), 3: (3, 3), 30: (30, 30)}
