"""Leaks, mixtures and keyword pages."""

import random

import pytest

from posemill.llm.leaks import build_index, find_leaks, leaked_items
from posemill.llm.mixing import count_tokens, mix_sources, mixture_report
from posemill.llm.stuffing import list_pages, list_shares

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 8))) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def windows(text, n=15):
    w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_exact_leaks_against_brute_force():
    rng = random.Random(6)
    items = [(i, sentence(rng.randint(10, 60), rng)) for i in range(25)]
    texts = []
    for _ in range(150):
        words = sentence(rng.randint(0, 120), rng).split()
        if rng.random() < 0.5:
            source = rng.choice(items)[1].split()
            n = rng.choice([13, 14, 15, 16, 25])
            at = rng.randrange(max(1, len(source) - n + 1))
            piece = source[at : at + n]
            if rng.random() < 0.2 and piece:
                piece[0] = "x" + piece[0]
            k = rng.randrange(len(words) + 1)
            words[k:k] = piece
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    want = {(t, i) for t, x in enumerate(texts) for i, y in items if windows(x) & windows(y)}
    index = build_index(items, 15, 3)
    got = find_leaks(index, texts)
    assert {(t, index.ids[i]) for t, i, e in got if e == 0} == want and len(want) > 20


def test_words_of_one_letter_leak_too():
    item = "a b c d e f g h i j k l m n o p"
    index = build_index([(1, item)], 15, 3)
    assert find_leaks(index, ["z " + item + " z", "b c d", item.replace("h", "hh")])[0][2] == 0
    assert [t for t, _, e in find_leaks(index, ["q", item.upper().replace(" ", "--")]) if e == 0] == [1]


def test_slips_are_found_within_the_budget():
    rng = random.Random(7)
    item = sentence(40, rng)
    index = build_index([(1, item)], 15, 3)
    for slip in ("replace", "drop", "add"):
        words = item.split()[5:22]
        piece = " ".join(words)
        k = len(piece) // 2
        piece = piece[:k] + {"replace": "q" + piece[k + 1 :], "drop": piece[k + 1 :], "add": "qq" + piece[k:]}[slip]
        found = find_leaks(index, [sentence(30, rng) + " " + piece + " " + sentence(30, rng)])
        assert found and 0 < found[0][2] <= 3, slip
    assert not find_leaks(index, [sentence(200, rng)])


def test_leaks_of_odd_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item)], "item_id long, text string")
    long = "word " * 300_000 + item
    docs = spark.createDataFrame([(1, item.upper(), "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, item[:40], "x"), (1, item, "x")], "doc_id long, text string, edits string")
    want = sorted([(1, 1), (1, 5), (1, 1), (1, 5), (4, 1), (4, 5)])
    for block in (2 << 20, 10):
        got = leaked_items(docs, "doc_id", "text", items, "item_id", "text", block_chars=block)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want
    assert leaked_items(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


# ---- mixtures


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng.randint(5, 60), rng), "big" if i % 10 else "small", "x") for i in range(3000)]
    rows += [(9000, None, "big", "x"), (9001, "  ", "big", "x"), (9002, "text", None, "x"), (9003, "text", "unknown", "x")]
    rows += [(10_000 + i, "a hot copy of one text", "big", "x") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def test_mixture_meets_shares_and_caps(spark, corpus):
    targets = spark.createDataFrame([("big", 600, 1), ("small", 400, 3), ("absent", 100, 1)], "source string, part int, most int")
    out, rates = mix_sources(corpus, targets, "doc_id", "text", "source", "part", "most")
    copies = out.collect()
    assert {r["source"] for r in copies} == {"big", "small"}
    count = {}
    for r in copies:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    cap = {"big": 1, "small": 3}
    assert all(count[r["doc_id"]] <= cap[r["source"]] for r in copies) and sum(10_000 <= d < 11_500 for d in count) <= 1
    report = {r["source"]: r for r in mixture_report(out, rates).collect()}
    assert report["big"]["actual_share"] == pytest.approx(0.6, abs=0.05) and report["small"]["rate"] <= 3
    again, _ = mix_sources(corpus, targets, "doc_id", "text", "source", "part", "most")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies))


def test_fixed_total_caps_the_small_source(spark, corpus):
    targets = spark.createDataFrame([("big", 1, 1), ("small", 9, 2)], "source string, part int, most int")
    _, rates = mix_sources(corpus, targets, "doc_id", "text", "source", "part", "most", total=1e9)
    assert {r["source"]: r["rate"] for r in rates.collect()} == {"big": 1.0, "small": 2.0}
    out, rates = mix_sources(corpus.limit(0), targets, "doc_id", "text", "source", "part", "most")
    assert out.count() == 0 and mixture_report(out, rates).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r["n"] for r in count_tokens(df, "t", "n").collect()]
    assert got[0] == 2 and got[1:3] == [0, 0] and got[3] > 1


# ---- keyword pages

PROSE = "The score of the pose was measured again because the first run had failed, and we kept the value. "


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        (PROSE * 4, False),
        ("Rescoring put olv-33404 at rank 182, docking alone at rank 141 (see batch 17). " * 3, False),
        ("cheap kinase inhibitor. Looking for kinase inhibitor? kinase inhibitor sale. " * 9, True),
        ("We are the fragment set of X, the best fragment set for you. It is the fragment set for fragment set and the fragment set. " * 5, True),
        ("buy\nsale\nhome\nlogin\ncart\nsupplier\n" * 6, True),
        ("biblioteca de compuestos\npedir en línea\noferta\nen existencia\n" * 6, True),
        ("pedir en línea Quillorn mejor precio en existencia biblioteca de compuestos oferta " * 6, True),
        ("home > cart > login > home > sitemap > login > cart > home > offers", True),
        ("[a](http://x.test/a?id=1)\n[b](http://y.test/b)\n" * 6, True),
        ("https://www.x.example/kapu?id=31\nhttps://y.test/a.html\n" * 6, True),
        ("tag:dock, tag:pose, tag:assay, tag:buy, tag:sale, tag:kit, tag:panel", True),
        ("SKU 123456 olv-1 assay kit\nSKU 99123 olv-2 probe molecule\n" * 5, True),
        ("pose 1 score -5.5 rmsd 1.2\nPOSE=2\tSCORE=-7.1\tRMSD=0.3\n3; -8.1; 0.2\n" * 6, False),
        ("olv-1: 12.5 nM\nolv-2: 80.1 nM\nolv-3\t4.4 uM\n" * 6, False),
        ("Die Bindung wurde mit 5 gemessen und ist schwächer als gedacht. " * 5, False),
        (PROSE * 3 + "\nbuy\nsale\nhome\nlogin\ncart\n", False),
        (PROSE + "\n" + "buy\nsale\nhome\nlogin\ncart\nsupplier\n" * 8, True),
        ("", False), (None, False), ("...", False),
    ],
)
def test_list_shares(text, spam):
    total, listed = list_shares([text])
    assert (listed[0] * 2 > total[0]) == spam


LONG = "We are told that the finest docking software for every laboratory in the whole country is made by the people of Tarsundel who never sleep."


@pytest.mark.parametrize("between", ["\n", " ", "\n\n"])
@pytest.mark.parametrize(
    ("text", "spam"),
    [
        ("The docking software of the docking software in Tarsundel.", True),
        (LONG, True),
        (LONG.replace(" docking ", " docking software and docking "), True),
    ],
)
def test_recurrence_across_lines_and_sentences(text, spam, between):
    total, listed = list_shares([PROSE, between.join([text] * 200), PROSE + LONG])
    assert [bool(a * 2 > b) for a, b in zip(listed, total, strict=True)] == [False, spam, False]


def test_scattered_sentences_are_no_recurrence():
    rng = random.Random(1)
    often = [
        "The grid for the site was too small, so poses are missing.",
        "We still lack the second measurement, which comes on Monday with the rest of the plates.",
        "Without water in the pocket the value falls.",
        "The ring turns when the side chain of the residue changes its place, which the first run had not shown at all.",
        "Docking alone ranked it low.",
    ]
    text = "\n".join(" ".join(rng.choices(often, k=3)) for _ in range(12))
    total, listed = list_shares([text])
    assert listed[0] * 2 <= total[0]


def test_list_pages_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "buy " * 300_000, 1), (3, PROSE, 1), (None, PROSE, 1)], "doc_id long, text string, share int")
    got = sorted(((r["doc_id"], r["share"] > 0.5) for r in list_pages(docs, "doc_id", "text").collect()), key=str)
    assert got == [(1, False), (2, False), (3, False), (3, True), (None, False)]
    assert list_pages(docs.limit(0), "doc_id", "text").count() == 0


def test_prose_of_any_language_is_no_list():
    prose = [
        "Program dokujący sprawdza każdą pozę cząsteczki w kieszeni białka i zapisuje jej energię. Po tym kroku wybieramy tylko najlepsze warianty, a resztę odkładamy na później. "
        "Wyniki z poniedziałku różnią się nieco od wcześniejszych, bo zmieniliśmy ładunek jednego atomu.",
        "Программа проверяет каждую позу молекулы в кармане белка и записывает её энергию. После этого шага мы выбираем только лучшие варианты, остальные откладываем на потом. "
        "Результаты понедельника немного отличаются от прежних, потому что изменился заряд одного атома.",
        "Le logiciel vérifie chaque pose de la molécule dans la poche et note son énergie. Après cette étape nous gardons seulement les meilleures variantes, les autres attendent. "
        "Les résultats de lundi diffèrent un peu des précédents, parce que la charge d'un atome avait changé.",
        "Ohjelma tarkistaa molekyylin jokaisen asennon proteiinin taskussa ja kirjaa sen energian. Tämän vaiheen jälkeen valitsemme vain parhaat muunnelmat, muut jäävät odottamaan.",
        "软件检查分子在蛋白质口袋中的每个姿势并记录其能量。完成这一步之后，我们只保留最好的变体，其余的以后再看。星期一的结果与以前略有不同，因为一个原子的电荷改变了。",
    ]
    total, listed = list_shares(prose)
    assert (total >= 12).all() and (listed <= 0.1 * total).all()
    stuffed = ["szybka dostawa tanio zestaw testowy oprogramowanie sklep " * 12, "对接软件 试剂盒 便宜 购买 " * 30]
    total, listed = list_shares(stuffed)
    assert (listed > 0.5 * total).all()


def test_leaks_with_a_broken_and_an_intact_place_and_in_parts():
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar".split()
    item = " ".join(words)
    doubled = " ".join([*words[:7], "hotelhotelhotel", *words[8:]])
    texts = [f"{doubled} and then {item} end", doubled, item, "nothing", None, " ".join([item] * 400), "x " * 5000 + item]
    index = build_index([(0, item), (1, "short")], 15, 3)
    for most in (1 << 24, 200, 20):
        exact = {(t, i) for t, i, n in find_leaks(index, texts, most) if n == 0}
        assert exact == {(0, 0), (2, 0), (5, 0), (6, 0)}, most
