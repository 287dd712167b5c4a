"""Encoding, leaked passages, garbled text."""

import random
from collections import Counter
from pathlib import Path

import pytest

from sluicebox.llm import garbled as G
from sluicebox.llm import leaked as L
from sluicebox.llm.bpe import Encoder, encode_corpus

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary file")
    own = tokenizers.Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


def odd_texts():
    rng = random.Random(1)
    fixed = ["", "a" * 30, "aaab" * 999, " " * 4001 + "x", "<|endoftext|> hi", "it's we'll they've I'd 'tis", "½¼ 12½ Ⅷ ٣", "é́ é क्षि", "😀 👩‍👩‍👧", "x\x1c \x1d \x85 y", "\n\n\n x  ", "z" * 20_000]
    return fixed + ["".join(rng.choice("ab ’ñ\n\t é1½​　'sld") for _ in range(rng.randint(0, 60))) for _ in range(2000)]


def test_ids_of_the_library(spark, reference):
    texts = [*odd_texts(), None, None]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id bigint, text string, ids string")
    got = {r.id: list(r.ids) for r in encode_corpus(df, "text", VOCABULARY, block_chars=5000).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == (reference.encode(text, add_special_tokens=False).ids if text else []), text
    assert encode_corpus(df.where("false"), "text", VOCABULARY).count() == 0


def test_memory_of_words_is_bounded(reference, monkeypatch):
    monkeypatch.setattr("sluicebox.llm.bpe.KEPT_WORDS", 5)
    encoder = Encoder(VOCABULARY)
    for text in ("one two three four five six seven", "eight one two", "one"):
        ids, counts = encoder([text])
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


WORDS = [a + b for a in ("gran", "har", "lod", "tur", "wea", "quar", "sig", "bri", "mar", "fen") for b in ("ary", "vest", "ging", "pike", "ver", "ry", "nal", "dge", "ket", "der")]


def passage(rng, count):
    return [rng.choice(WORDS) for _ in range(count)]


def leaks(texts, passages, lefts=None, words=16):
    folded = [L.fold_passage(" ".join(p)) for p in passages]
    own = L.Passages(list(range(len(passages))), folded, L.scheme_for(folded, words), words)
    return {(i, k): w for i, k, w in L.leaked_in(own, texts, lefts or [None] * len(texts))}


def lines(words, width=6):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def test_parts_and_counts():
    rng = random.Random(2)
    items = [passage(rng, 60) for _ in range(5)]
    filler = [passage(rng, 40) for _ in range(12)]
    texts = ["\n".join(lines(filler[k] + items[k % 5][8 : 8 + n] + filler[-k])) for k, n in enumerate((60, 20, 17, 12, 30))]
    got = leaks(texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (4, 4)}
    assert 17 <= got[2, 2] <= 18 and got[0, 0] == 52


def test_noise_adverts_breaks_and_columns():
    rng = random.Random(3)
    item, other = passage(rng, 50), passage(rng, 200)
    own = item[5:40]
    upper = " ".join(own).upper().replace("I", "1").replace("O", "0")
    broken = "\n".join(" ".join(other[:20] + own + other[20:40])[i : i + 23] + "-" for i in range(0, 500, 23))
    advert = [*lines(own[:18]), "------", "TO LET a handsome weaver apply within today", "------", *lines(own[18:])]
    left, right = lines(own, 4), lines(other[:40], 4)
    side = "\n".join(a.ljust(60) + b for a, b in zip(left + [""] * 20, right))
    turns = [x for pair in zip(left, right) for x in pair]
    texts = [upper, broken, "\n".join(advert), side, "\n".join(turns), "\n".join(turns)]
    lefts = [None, None, None, None, [100, 500] * (len(turns) // 2), None]
    got = leaks(texts, [item, passage(rng, 50)], lefts)
    # the last is the one before without edges: lines between lines are skipped like adverts
    assert {i for i, _ in got} == {0, 1, 2, 3, 4, 5}
    assert got[2, 0] >= 33


def test_recall_on_misread_parts():
    rng = random.Random(4)
    items = [passage(rng, 60) for _ in range(150)]
    texts = []
    for item in items:
        at = rng.randint(0, 35)
        text = list(" ".join(passage(rng, 30) + item[at : at + 25] + passage(rng, 30)))
        for i in range(len(text)):
            if text[i] != " " and rng.random() < 0.02:
                text[i] = rng.choice("xzwp")
        texts.append("".join(text))
    got = leaks(texts, items)
    assert sum((i, i) in got for i in range(150)) >= 140
    assert all(i == k for i, k in got)


def test_leaks_as_a_table(spark):
    rng = random.Random(5)
    item = passage(rng, 30)
    pages = spark.createDataFrame([(1, " ".join(item)), (2, ""), (3, None), (4, " ".join(passage(rng, 5000)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id bigint, passage string")
    found = L.find_leaks(pages, "doc_id", "text", None, items, "item_id", "passage")
    assert [tuple(r) for r in found.collect()] == [(1, 7, 30)]
    assert L.find_leaks(pages.where("false"), "doc_id", "text", None, items, "item_id", "passage").count() == 0
    assert L.find_leaks(pages, "doc_id", "text", None, items.where("false"), "item_id", "passage").count() == 0


def test_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 400)
    monkeypatch.setattr(L, "PASS_BYTES", 1500)
    monkeypatch.setattr(L, "HELD_BYTES", 300)
    rng = random.Random(8)
    items = [passage(rng, 25) for _ in range(10)]
    pages = spark.createDataFrame([(f"d{i}", " ".join(p)) for i, p in enumerate(items)], "id string, text string")
    listed = spark.createDataFrame([(f"i{i}", " ".join(p)) for i, p in enumerate(items)], "id string, passage string")
    found = L.find_leaks(pages, "id", "text", None, listed, "id", "passage")
    assert sorted((r.id, r.item_id) for r in found.collect()) == [(f"d{i}", f"i{i}") for i in range(10)]


RUSSIAN = "в городе вчера говорили что станция близ старой мельницы стоит пустая уже пять долгих лет и никто из жителей не хочет чинить её крышу до весны"
GREEK = "το παλιό λιμάνι της πόλης έμεινε άδειο όλο τον χειμώνα και κανείς από τους ψαράδες δεν θέλησε να βγει στη θάλασσα πριν από την άνοιξη"
CHINESE = "城外的老磨坊已经空了五年没有一个居民愿意在春天之前修理它的屋顶"


@pytest.mark.parametrize("text", [RUSSIAN, GREEK, CHINESE])
def test_passages_of_other_scripts(text):
    rng = random.Random(10)
    item = text.split() if " " in text else [text]
    words = lines(passage(rng, 30) + [w.upper() for w in item] + passage(rng, 30))
    assert (0, 0) in leaks(["\n".join(words), " ".join(passage(rng, 80)), text[: len(text) // 4]], [item])
    assert set(leaks(["\n".join(words), " ".join(passage(rng, 80)), text[: len(text) // 4]], [item])) == {(0, 0)}


def test_words_of_two_scripts_fold_to_the_commoner():
    assert L.fold("sp\u0413te W\u0413lder") == L.fold("spte Wlder") and L.fold("гоpод") == L.fold("город".replace("р", ""))
    assert L.fold("") == b"" and L.fold("\U0001f600 é") == b" "


@pytest.mark.parametrize("letters", [40, 342, 575, 4000])
def test_adverts_of_any_length(letters):
    rng = random.Random(11)
    item = passage(rng, 40)
    other = " ".join(passage(rng, 900))[:letters]
    page = "\n".join([*lines(item[:18]), "------", other, "------", *lines(item[18:])])
    assert leaks([page], [item])[0, 0] >= 38


def test_short_words():
    rng = random.Random(12)
    item = [rng.choice(["a", "we", "xy", "q", "m", "to", "z", "hd", "up", "my"]) for _ in range(24)]
    filler = passage(rng, 60)
    assert set(leaks([" ".join(filler[:30] + item[2:20] + filler[30:]), " ".join(filler)], [item])) == {(0, 0)}


def test_planted_edits_meet_at_the_wanted_recall():
    rng = random.Random(13)
    folded = [L.fold_passage(" ".join(passage(rng, 60))) for _ in range(300)]
    assert L.planted_recall(folded, L.scheme_for(folded, recall=0.99, misread=0.06), misread=0.06, seed=77) >= 0.97
    assert len(L.scheme_for(folded, recall=0.9, misread=0.0).samples) <= len(L.scheme_for(folded, recall=0.999, misread=0.1).samples)


def test_size_of_the_tables():
    rng = random.Random(14)
    folded = [L.fold_passage(" ".join(passage(rng, 120))) for _ in range(500)]
    scheme = L.Scheme(2)
    marks = sum(t[0].nbytes for t in L.Passages([0], folded[:1], scheme).tables)
    assert (L.Passages(list(range(500)), folded, scheme).nbytes() - marks) / sum(map(len, folded)) < 20
    assert [len(b) for b in L._blocks([(i, f * 20_000) for i, f in enumerate(folded[:4])])] == [1, 1, 1, 1]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_exact_edits():
    rng = random.Random(15)
    for _ in range(500):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert L.edit_distance(a, b) == plain_distance(a, b)
    assert L._stretch(b"abcdefgh", b"abcxefgh") == (8, 1) and L._stretch(b"abc", b"") == (0, 0) and L._stretch(b"abcdef", b"abdef" + b"z" * 9) == (6, 1)


CLEAN = [
    "Die späte Bürgermeister war ohne Schäfer verzögert an der Straße.", "Après la forêt, 5 élèves ont déjà trouvé la côte.", "La niña perdió más de £3 en el almacén.", "Któż odnowił źródło pod miastem, łódź była żniwa.",
    "Говорят, что станция близ города стоит пустая уже пять лет.", "The weaver’s café — at 61½ the bushel — was “rather too late”.", "Não há região em maçã, disse irmão.",
]


@pytest.mark.parametrize("pair", G.PAIRS)
def test_garbling_can_be_undone(pair):
    for line in CLEAN:
        wrong = G.garble(line, pair)
        plain = line if pair[0] == "utf-8" else None
        if plain and wrong != line:
            assert G.ungarble(wrong, pair) == plain
        assert G.garble("plain ASCII", pair) == "plain ASCII"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    texts = []
    for _ in range(400):
        words = [w for line in CLEAN for w in line.split()]
        texts.append("\n".join([*rng.sample(CLEAN, 4), " ".join(rng.choices([w for w in CLEAN[0].split()], k=6)), " ".join(rng.choices(words, k=5))]))
    for i in range(0, 60):
        texts[i] = G.garble(texts[i], G.PAIRS[i % 8])
    return G.train(texts)


def test_found_and_restored(spark, model):
    garbled = [G.garble(line, pair) for line, pair in zip(CLEAN, [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp437", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "mac-roman", 1), ("utf-8", "cp1252", 2)])]
    pages = [*CLEAN, *garbled, "at �57 examined", "", None, CLEAN[0] + "\n" + garbled[5] + "\nplain\n", "é" * 9000, "plain ascii " * 5000]
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "id bigint, t string, restored string")
    rows = {r.id: r for r in G.restore_garbled(df, "t", model).collect()}
    assert [i for i in range(7) if rows[i].garbled_chars] == []
    assert [rows[7 + i].restored for i in range(7)] == CLEAN
    assert all(rows[7 + i].garbled_chars > 0 for i in range(7))
    assert (rows[14].garbled_chars, rows[14].lost_chars, rows[14].restored) == (1, 1, pages[14])
    assert [(rows[i].garbled_chars, rows[i].restored) for i in (15, 16)] == [(0, ""), (0, None)]
    assert rows[17].restored == CLEAN[0] + "\n" + CLEAN[5] + "\nplain\n"
    assert rows[19].restored == pages[19]
    assert G.restore_garbled(df.where("false"), "t", model).count() == 0


FOREIGN = [
    "Η πόλη είναι παλιά και το λιμάνι της έμεινε άδειο όλο τον χειμώνα", "Příliš žluťoučký kůň úpěl ďábelské ódy v příběhu o řece", "Çok güzel bir şehir, ağaçlar ve ışıklar içinde", "Đường phố Hà Nội rất đông người",
]


@pytest.mark.parametrize("line", FOREIGN)
def test_clean_languages_that_the_sample_lacks(model, line):
    label = G.label_lines(model, [line])[0]
    assert label is None or G.restore_line(model, line, label) == (line, 0)


def test_long_lines_are_seen_with_overlap(model):
    line = " ".join([CLEAN[0]] * 200)
    assert len(line) > 3 * G.LONG_LINE
    wrong = line[:4500] + G.garble(line[4500:7000], ("utf-8", "cp1252", 1)) + line[7000:]
    restored, hits = G.restore_line(model, wrong, G.label_lines(model, [wrong])[0])
    assert restored == line and hits > 50


def test_no_alphabet_is_needed():
    rng = random.Random(16)
    words = "řeka žluťoučký kůň úpěl ďábelské ódy příběh město škola přítel včera říká že už není čas".split()
    texts = ["\n".join(" ".join(rng.choices(words, k=7)) for _ in range(6)) for _ in range(200)]
    own = G.train([G.garble(t, ("utf-8", "cp1252", 1)) if i % 20 == 0 else t for i, t in enumerate(texts)])
    assert all(label is None for label in G.label_lines(own, texts[0].split("\n")[:0] + texts[1].split("\n")))
    wrong = G.garble(texts[1].split("\n")[0], ("utf-8", "cp1252", 1))
    assert G.restore_line(own, wrong, G.label_lines(own, [wrong])[0])[0] == texts[1].split("\n")[0]


def test_training_on_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "id bigint, t string")
    own = G.train_on(empty, "t")
    assert [r.garbled_chars for r in G.restore_garbled(empty, "t", own).collect()] == [0, 0]


def test_the_model_counts_every_page(spark):
    rng = random.Random(25)
    texts = ["plain", None, "", *(f"{rng.choice(CLEAN)} {i % 7}\n{rng.choice(CLEAN)}" for i in range(4000))]
    for i in range(100, 130):
        texts[i] = G.garble(texts[i], G.PAIRS[i % 8])
    texts[3990:3993] = ["Nebyla to řeka. " * 3, "Řeka byla tam.", "stará řeka"]
    own = G.train_on(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t")
    whole = G.train([t for t in texts if t])
    assert (own.symbol == whole.symbol).all() and (own.emission == whole.emission).all() and (own.enter == whole.enter).all()
    assert own.chars == whole.chars >= {"ř", "á"} and own.neighbours == whole.neighbours >= {"ře"}


def test_garbled_pairs_follow_from_those_of_clean_lines():
    lines = [*CLEAN, "★ x…", "İstanbul ß 😀"]
    for to in (str, *(lambda c, pair=pair: G.garble(c, pair) for pair in G.PAIRS)):
        first, second, n = G.Pairs.of(lines).mapped(to)
        got = Counter()
        for a, b, k in zip(first.tolist(), second.tolist(), n.tolist()):
            got[chr(a) + chr(b)] += int(k)
        made = "\n".join(["", *(to(line) for line in lines), ""])
        assert got == Counter(a + b for a, b in zip(made, made[1:]))
