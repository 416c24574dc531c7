import os
import random
import re
import unicodedata

import pytest

from cinequery.llm import encode, leaks, lookalike, sentences

tokenizers = pytest.importorskip("public_tokenizers")


# -- problem 1


SAME = [
    ("Diện tích 80 m²", unicodedata.normalize("NFD", "Diện tích 80 m²")),
    ("Diện", "Diện"),
    ("LIVE 13:13", "Ｌ­ＩＶＥ　１３：​１３"),
    ("a b", "a b"),
    ("Score", "Sсоrе"),
    ("ĐƯỜNG", "ƉƯỜNG"),
    ("62-40", "62‑40"),
    ("\u5927\u5c71", "\u2f24\u2f2d"),
    ("Stage VI", "Stage Ⅵ"),
    ("ガ", "ｶﾞ"),
    ("Ăn", "Ӑn"),
    ("end", "end "),
    ("vup a", "νυρ α"),
    ("QWGV", "ԚԜԌѴ"),
    ("nuh", "ոսհ"),
    ("oh", "ⲟh"),
    ("Rio A", "Rio Ꭺ"),
    ("ïe", "їе"),
]
DIFFERENT = [("TEAM", "Team"), ("mì", "mi"), ("mì", "mí"), ("m²", "m2"), ("m²", "m₂"), ("①", "1"), ("1", "١"), ("เก", "กเ"), ("a  b", "a b"), ("か", "カ"), ("𝐀", "A"), ("I", "l"), ("0", "O"), ("1", "l"), ("i", "ı"), ("f", "ſ"), ("o", "σ"), ("ß", "β"), ("b", "6"), ("-", "ー"), ("m", "rn")]


def lines(spark, pairs, **more):
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [(2 * i, f"v{i}", 0, "ocr", a), (2 * i + 1, f"v{i}", 0, "ocr", b)]
    return spark.createDataFrame(rows, "line_id long, video_id string, shot_id int, lane string, text string")


def pairs_of(df):
    return sorted(map(tuple, lookalike.same_looking_pairs(df, "line_id", ["video_id", "shot_id", "lane"], "text").collect()))


def test_same_and_different_looks(spark):
    cases = SAME + DIFFERENT
    assert pairs_of(lines(spark, cases)) == [(2 * i, 2 * i + 1) for i in range(len(SAME))]


def test_canonical_member_is_deterministic_and_kept_columns_stay(spark):
    df = spark.createDataFrame([("Ｌive", 1), ("Live", 2), (None, 3), ("", 4), ("​ ", 5), ("Live", 6), ("Live​", 7)], "text string, n int")
    got = {r.n: r.canonical for r in lookalike.canonical_form(df, "text").collect()}
    assert got == {1: "Live", 2: "Live", 3: None, 4: "", 5: "", 6: "Live", 7: "Live"}
    with pytest.raises(ValueError):
        lookalike.canonical_form(df, "text", "n")


def test_looks_of_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "v", 0, "a", "--"), (2, "v", 0, "a", "‐‐"), (3, None, 0, "a", "x"), (4, None, 0, "a", "х"), (5, "v", 0, "a", None), (6, "v", 0, "a", "x"), (6, "v", 0, "a", "x"), (7, "v", 0, "a", "х"), (8, "v", 0, "b", "х"), (9, "v", 0, "a", "x")],
        "line_id long, video_id string, shot_id int, lane string, text string",
    )
    assert pairs_of(df) == [(6, 7), (7, 9)]
    assert pairs_of(df.limit(0)) == []
    long = "ab​" * 200_000
    assert pairs_of(lines(spark, [(long, long.replace("​", ""))])) == [(0, 1)]


def test_large_classes_are_paired_in_slices(spark):
    looks = ["Live", "Ｌive", "Li​ve", "Livе"]
    rows = [(i, "v", 0, "a", looks[i % 40 if i % 40 < 4 else 0]) for i in range(200)]
    df = spark.createDataFrame(rows, "line_id long, video_id string, shot_id int, lane string, text string")
    want = sorted((i, j) for i, _, _, _, a in rows for j, _, _, _, b in rows if i < j and a != b)
    for most in (3, 10**6):
        assert sorted(map(tuple, lookalike.same_looking_pairs(df, "line_id", ["video_id", "shot_id", "lane"], "text", most).collect())) == want


# -- problem 6


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)


def test_ids_are_the_tokenizer_s(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = "abcdehilnorst ABC \n\t  0123 .,!?'’ àạảệđ 日本語ไทย अनु 🏮​ "
    texts = ["", " ", "Hello  world\n\n", "<|endoftext|> a</s>", "thing" * 300, "ภาษาไทย" * 90] + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        assert encoder.text(text) == other.encode(text, add_special_tokens=False).ids


def test_both_merges_agree(encoder):
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choices("aábcthng写", k=rng.randint(1, 80))).encode()
        assert encode.merge_short(word, encoder.ranks) == encode.merge_long(word, encoder.ranks)


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "a b", None), (None, "a", "x")], "doc_id long, text string, ids string")
    got = encode.encode_corpus(df, "doc_id", "text", tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [(1, [64, 275]), (2, []), (3, []), (4, [64, 275]), (None, [64])]
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0


# -- problem 7


ITEM = "Phía sau bác nông dân là giá sách dán nhãn Stosik, bên trái treo 32 đồng hồ treo tường màu xám tro."


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "Mở đầu. " + " ".join(words[3:17]) + " Hết."),
        (2, " ".join(words[3:14])),  # eleven words
        (3, unicodedata.normalize("NFD", ITEM.upper()).replace(" ", "\n* ", 5)),
        (4, " ".join(words[:10]) + " khác " + " ".join(words[10:])),
        (5, None),
        (6, ""),
        (7, "..."),
        (8, ITEM.replace("nông", "nô­ing").replace("đồng", "đ​ồng")[:0] + ITEM.replace("nông", "nô­ng")),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "quá ngắn"), (4, None)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    got = leaks.find_leaks(df, items, "doc_id", "text", "item_id", "text", 12).collect()
    spans = {}
    for r in got:
        spans.setdefault((r.doc_id, r.item_id), []).append(dict(docs)[r.doc_id][r.start_char : r.end_char])
    assert {k[0] for k in spans} == {1, 3, 4, 8} and {k[1] for k in spans} == {1, 2}
    assert spans[(1, 1)] == [" ".join(words[3:17]).rstrip(",")]
    assert spans[(3, 1)][0] == docs[2][1].rstrip(".")
    assert spans[(4, 1)] == [" ".join(words[10:]).rstrip(".")]
    assert leaks.find_leaks(df.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.find_leaks(df, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_leaks_equal_all_stretches_compared():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)]
    for least in (1, 2, 3, 4, 5, 12):
        items = [(i, " ".join(rng.choices(vocabulary[: rng.randint(1, 6)], k=20))) for i in range(15)]
        search = leaks.Search(items, least)
        for _ in range(120):
            text = rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary[: rng.randint(1, 6)], k=rng.randint(0, 30)))
            said = text.replace(",", "").split()
            want = set()
            for p, (_, t) in enumerate(items):
                held = {tuple(t.split()[i : i + least]) for i in range(21 - least)}
                inside = {k for j in range(len(said) - least + 1) if tuple(said[j : j + least]) in held for k in range(j, j + least)}
                want |= {(p, k) for k in inside}
            starts = [m.start() for m in re.finditer(r"\w+", text)]
            assert {(p, k) for p, a, b in search.scan(text) for k, at in enumerate(starts) if a <= at < b} == want


def test_leaks_in_shards_are_the_same(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    held = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(25)]
    texts = [(i, " ".join([*rng.choices(vocabulary, k=20), *held[i % 25][1].split()[3:17], *rng.choices(vocabulary, k=20)])) for i in range(60)]
    texts += [(100, held[7][1] + " x"), (100, held[7][1] + " x"), (101, None), (102, " ".join(["w1"] * 5000))]
    df, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*held, held[3], (99, None), (98, "w1 " * 300)], "item_id long, text string")
    one, many = (sorted(map(tuple, leaks.find_leaks(df, items, "doc_id", "text", "item_id", "text", 12, most).collect())) for most in (10**6, 200))
    assert one == many and (102, 98, 0, 14999) in one and one.count((100, 7, 0, len(held[7][1]))) == 2


# -- problem 8


@pytest.fixture(scope="module")
def tagger():
    """Trained on texts that are written out here."""
    base = [
        "The firm Ladur Inc. sells tofu (min. order 41 pcs.) by the pier. Dr. Kusei explains why it costs approx. 5,000 coins. Open L22_V066.jsonl and skip to 18:20. See www.soulou.example/v2.3 on Monday.",
        "“Hold the line! Don't stop!” shouted the cook. Then he said, “We will go tomorrow.” The show Zapp! returns in Sept. with us. Well... perhaps not after all… Bring rice, etc. Open page 3, look at Fig. 4. Bring rice, etc. and pay.",
        "Đoàn xe rời TP. Kusei lúc 9.45 sáng nay. Người bán có bánh, chè, v.v. Chúng tôi gặp PGS. TS. Nam ở Q. 9, ngay sau ga. “Về đích rồi! Nhanh lên!” cô giáo hô vang. Rồi cô nói: “Mai ta lại đi.” Tỷ số là 3-4, còn chờ gì nữa?! Ở đây có mì, v.v. và ai cũng muốn ăn.",
        "Man nimmt z. B. Mango und will mehr! Der Bus hält in St. Neidair um 12.23 Uhr. Es gibt Brot, Honig usw. Dann sagt er: „Morgen gehen wir.“ Am 24. Oktober kommt er.",
        "Запись лежит на www.a.example/v4.2 с субботы. Цена выросла до 9 руб. за штуку. Тут есть хлеб, мёд и т. д. Откройте стр. 3, рис. 5. «Быстрее! Не стой!» — кричит он.",
        "为什么老师要卖青芒果？车队在20.48离开，领先49.4秒。“快点！别停！”主持人在旁边喊道。主持人说：“明天我们做完练习。” 那个……厨师好像还没好。",
        "1. Bring rice, etc.\n2. Open page 3, look at Fig. 4.\n3. Dr. Kusei explains it.",
        "ขบวนรถออกจากเนินชาเวลา 10.22 นาฬิกา ทำไมคุณครูจึงมา ปี 2042 มีคนมากๆ วันนี้เราจะไป",
    ]
    return sentences.fit(base * 12)


CASES = [
    "Dr. Brow explains why tofu costs approx. 9,000 coins.| The score was 3 vs. 4.",
    "“Hold the line! Don't stop!” shouted the cook.| Bring rice.",
    "1. Bring rice, etc.\n2. Open page 3, look at Fig. 4.".replace("\n", "|\n"),
    "Đoàn xe rời TP. Nam lúc 8.30 sáng nay.| Rồi cô nói: “Mai ta lại đi.”| Người bán có chè, v.v.| Chúng tôi gặp TS. Lan ở Q. 3, ngay sau ga.",
    "Title without a mark|\n\nThe bus left.|\n \n\nAnother\nline that\nwraps.",
    "车队在21.13离开，领先40.9秒。|“快点！别停！”主持人在旁边喊道。|为什么？|那个……厨师还没好。",
    "ขบวนรถออกจากเนินชาเวลา 9.30 นาฬิกา| ทำไมคุณครูจึงมา| ปี 2050 มีคนมากๆ",
    "Цена выросла до 7 руб. за штуку.| Откройте стр. 4, рис. 2.",
    "  No mark at all  ",
    # Written out by hand, in scripts the training texts above do not have.
    "Ես սիրում եմ գրքեր։| Նա ապրում է Երևանում։| Դու ո՞վ ես։",
    "ስሜ ዮሐንስ ነው።| አዲስ አበባ እኖራለሁ።| እንዴት ነህ፧",
    "ខ្ញុំចូលចិត្តអានសៀវភៅ។| គាត់ធ្វើការនៅក្រុង។| ពួកគេញ៉ាំបាយ។",
    "သူက ကျောင်းသား ဖြစ်တယ်။| သူမ ရန်ကုန်မှာ နေတယ်။",
    "ང་སློབ་གྲྭ་བ་ཡིན། |ཁོང་ལྷ་སར་བཞུགས།",
    "यह किताब अच्छी है।| वह घर गया।| क्या तुम आओगे?",
    "هذا كتاب جيد.| ذهب إلى البيت.| هل تأتي؟",
    "これは本です。|彼は家に帰りました。|来ますか？",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(tagger, case):
    text = case.replace("|", "")
    assert [text[a:b] for a, b in sentences.cut(text, tagger)] == [x.strip() for x in case.split("|")]


def test_undrawn_characters_keep_offsets(tagger):
    text = "Dr. Br\u00adow explains why tofu costs approx. 9,000 co\u200bins.\u200b Th\ufeffe score was 3 vs. 4."
    cut = text.index(" Th")
    assert [text[a:b] for a, b in sentences.cut(text, tagger)] == [text[:cut], text[cut + 1 :]]


def test_capitals_are_not_needed(tagger):
    text = "dr. brow explains why it costs approx. 9,000 coins. open page 3, look at fig. 4."
    assert [text[a:b] for a, b in sentences.cut(text, tagger)] == ["dr. brow explains why it costs approx. 9,000 coins.", "open page 3, look at fig. 4."]


def test_sentences_cover_all_that_is_drawn(spark, tagger):
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices(list("abAB .!?…\n\n\"“”()«»0 1。ก​ -"), k=rng.randint(0, 60)))
        found = sentences.cut(text, tagger)
        covered = "".join(text[a:b] for a, b in found)
        assert all(a < b for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        kept = lambda s: "".join(c for c in s if not c.isspace() and c != "​")
        assert kept(covered) == kept(text)
        assert all(text[a:b] == text[a:b].strip() for a, b in found)


def test_long_and_odd_documents(spark, tagger):
    for text in ("a. " * 100_000, '"' * 50_000, "“" * 50_000, "x" * 300_000, "\n\n" * 50_000, "...." * 50_000):
        sentences.cut(text, tagger)
    df = spark.createDataFrame([(1, None, 1), (2, "  \n\n ", 1), (3, "​﻿", 1), (4, "One. Two.", 1), (4, "One. Two.", 1), (None, "One.", 1)], "doc_id long, text string, n int")
    got = sorted(map(str, sentences.split_sentences(df, "doc_id", "text").collect()))
    assert len(got) == 5 and sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_a_model_is_kept_and_used_again(spark, tagger, tmp_path):
    sentences.save_model(spark, tagger, str(tmp_path / "model"))
    again = sentences.load_model(spark, str(tmp_path / "model"))
    assert again.weights == dict(tagger.weights) and again.pairs == dict(tagger.pairs)
    df = spark.createDataFrame([(1, "Dr. Brow left. He came back.")], "doc_id long, text string")
    assert [(r.start_char, r.end_char) for r in sentences.split_sentences(df, "doc_id", "text", again).collect()] == [(0, 14), (15, 28)]


def test_held_out_agreement(spark):
    """The tagger's decisions on documents it never saw are those of the sure rules."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect() if r.text]
    model = sentences.fit(texts[::2])
    right = total = 0
    for found, gold in sentences.examples(texts[1::2]):
        got = model.decode(found)
        right += sum(a == b for a, b in zip(got, gold))
        total += len(gold)
    assert total > 500 and right / total > 0.98
