"""Decontamination of scripts without spaces, of generic questions, and the recall of planted items."""

import random

from helixframe.llm import decontamination


def matches(spark, items, texts):
    index = decontamination.build_index(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.benchmark_matches(docs, index).collect()}


def test_scripts_without_spaces(spark):
    items = ["在一九六九年七月人类第一次登上月球是哪一个国家的宇航员。答案是美国的阿姆斯特朗。", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศใดในเอเชียตะวันออกเฉียงใต้", "what does the second law of thermodynamics say about entropy? it never decreases in a closed system."]
    texts = [
        f"今天的天气很好我们去公园散步。{items[0]}然后我们回家吃晚饭并且看电视。",
        f"ฉันชอบกินข้าวผัด{items[1]}และดื่มน้ำ",
        "今天的天气很好我们去公园散步然后回家吃晚饭并且看电视听音乐。" * 3,
        f"文章，{items[2]}。文章",
        "月球是地球的卫星。" * 5,
    ]
    assert matches(spark, items, texts) == {(0, 0), (1, 1), (3, 2)}


def test_a_generic_question_doesnt_decide(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    answer = " ".join(word() for _ in range(18)) + "."
    items = [f"Which of the following is true? {answer}", "Which river flows through the old town of Bern? The Aare."]
    beside = " ".join(word() for _ in range(40))
    texts = [f"{beside} Which of the following is true? {beside}", f"{beside} {items[0]} {beside}", f"{beside} Which river flows through the old town of Bern? {beside}", f"{beside} {answer} {beside}"]
    assert matches(spark, items, texts) == {(1, 0), (2, 1), (3, 0)}


def test_recall_of_planted_items(spark):
    """Whole items, and items with a word in ten changed, within other prose."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [f"{prose(rng.randrange(12, 45))}? {prose(rng.randrange(2, 14))}." for _ in range(120)]
    texts, want, near = [], set(), set()
    for i, item in enumerate(items):
        texts.append(f"{prose(rng.randrange(200))} {item} {prose(rng.randrange(200))}")
        want.add((len(texts) - 1, i))
        w = item.split()
        if len(w) >= 20:
            w[rng.randrange(len(w))] = "zzz"
            texts.append(f"{prose(90)} {' '.join(w)} {prose(90)}")
            near.add((len(texts) - 1, i))
    clean = len(texts)
    texts += [prose(300) for _ in range(150)]
    found = matches(spark, items, texts)
    assert want <= found and len(near & found) >= 0.95 * len(near)
    assert not any(d >= clean for d, _ in found)
