"""Problems 6, 7 and 9."""

import random

import numpy as np
import pytest

from citeloom.llm import contamination, names, sentences
from citeloom.llm.text import plain

PEOPLE = [
    ["William F. Daliril", "Daliril WF", "WILLIAM F. DALIRIL", "Bill Daliril", "Dr. William F. Daliril", "William F. Dalirli"],
    ["Anna-Lena Bastotrack", "Anna Lena Bastotrack", "AnnaLena Bastotrack", "Bastotrack, Anna-Lena", "Bastotrack A"],
    ["Daniel Behiskosk", "Behiskosk, Daniel", "Daniel Behiskosk, PhD"],
    ["Daniela Behiskosk", "daniela behiskosk"],
    ["Gabriela Susanna Bryfliplas", "G. S. Bryfliplas", "Gabi Susanna Bryfliplas"],
    ["Yusuf L. Fofogünd", "Yusuf Fofogund", "Y. L. Fofogünd"],
    ["Kivykern Foundation for Digital Archives and Reasoning", "Kivykern Fdn. for Digital Archives & Reasoning", "Kivykern Foundation for Digital Archvies and Reasoning"],
    ["Institute of Digital Archives, Krobytrit", "Digital Archives Institute Krobytrit"],
    ["Drefubrem Foundation for Digital Archives and Reasoning"],
    ["Mateo Hoplerax", "Hoplerax Mateo", "M. Hoplerax"],
    ["Mateo Furinar"], ["Uma Furinar", "Uma Furinra"], ["Mateo Bybezush"], ["Mateo Dristyseff"], ["Rosa Hoplerix"],
]


def test_spellings(spark):
    typed = [n for group in PEOPLE for n in group] + ["  Mateo Furinar ", "", None, " ", "Mateo Furinar", "x" * 20_000]
    linked = names.link_spellings(spark.createDataFrame([(n, 1) for n in typed], "name string, entity int")).collect()
    assert len(linked) == len({r["name"] for r in linked}) == sum(map(len, PEOPLE)) + 1
    got = {}
    for r in linked:
        got.setdefault(r["entity"], set()).add(r["name"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [*PEOPLE, ["x" * 20_000]]))


def test_ambiguous_initials_link_to_nobody(spark):
    typed = ["Jorge Lakrigirs", "Johannes Lakrigirs", "J. Lakrigirs", "Lakrigirs, J. P.", "Jorge P. Lakrigirs"]
    pairs = {tuple(r) for r in names.spelling_pairs(spark.createDataFrame([(n,) for n in typed], "name string")).collect()}
    assert pairs == {("Jorge Lakrigirs", "Jorge P. Lakrigirs"), ("Jorge Lakrigirs", "Lakrigirs, J. P."), ("Jorge P. Lakrigirs", "Lakrigirs, J. P.")}


def test_a_misspelled_given_name_is_linked_however_often_it_occurs(spark):
    rng = random.Random(12)
    families = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(120)]
    typed = [f"Emre {f}" for f in families] + [f"Emmre {f}" for f in families[:5]]
    pairs = names.spelling_pairs(spark.createDataFrame([(n,) for n in typed], "name string"))
    assert {tuple(r) for r in pairs.collect()} == {(f"Emmre {f}", f"Emre {f}") for f in families[:5]}
    assert names.given_match("igro", 70, "igor", 6850) == names.given_match("igro", 7, "igor", 685) == names.given_match("igro", 1, "igor", 69) == "slip"
    assert names.given_match("jean", 14, "jan", 111) is None and names.given_match("emil", 140, "emir", 1110) is None


def test_no_names(spark):
    none = spark.createDataFrame([(None,)], "name string")
    assert names.link_spellings(none).count() == 0 and names.spelling_pairs(none).count() == 0


@pytest.mark.parametrize("block", [3, 30])
def test_blocks_miss_no_pair_that_shares_a_whole_word_and_an_initial(spark, block):
    rng = random.Random(7)
    nodes = [(f"n{i}", [rng.choice(["zaplumav", "fofogund"]), "".join(rng.choice("abcdef") for _ in range(6))]) for i in range(40)]
    df = spark.createDataFrame([(n, w, w) for n, w in nodes], "node string, words array<string>, others array<string>")
    got = {tuple(r) for r in names.candidate_pairs(df, block).collect()}
    want = {(a, b) for a, x in nodes for b, y in nodes if a < b and x[0] == y[0] and x[1][:3] == y[1][:3]}
    assert want <= got


@pytest.mark.parametrize("block", [3, 30])
def test_names_with_only_initials_or_two_letters_meet_a_common_family_name(spark, block):
    rng = random.Random(13)
    givens = ["j", "b", "bo", "jo"] + [rng.choice("jb") + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80)]
    df = spark.createDataFrame([(g, ["smith"] + [g] * (len(g) > 1), ["smith", g]) for g in givens], "node string, words array<string>, others array<string>")
    got = {tuple(r) for r in names.candidate_pairs(df, block).collect()}
    assert {(a, b) for a in givens for b in givens if a < b and a[0] == b[0] and min(len(a), len(b)) < 3} <= got
    typed = ["Bo Smith", "Smith, B.", "J. Q. Smith", "Jquux Qabc Smith"] + [f"J{g[1:]} Smith" for g in givens if len(g) > 2]
    linked = {r["name"]: r["entity"] for r in names.link_spellings(spark.createDataFrame([(n,) for n in typed], "name string")).collect()}
    assert linked["Bo Smith"] == linked["Smith, B."] and linked["J. Q. Smith"] == linked["Jquux Qabc Smith"]


def test_blocks_lose_few_pairs_that_compare_as_one(spark):
    """Recall of the blocking, measured against the comparison of all pairs of a sample."""
    rng = random.Random(41)
    makes = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    families, givens, typed = [makes(4) for _ in range(12)], [makes(3) for _ in range(8)] + ["william", "bo"], set()

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("xyz") + w[k:], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])

    for _ in range(500):
        f, g = rng.choice(families), rng.choice(givens)
        g = rng.choice([g, g, g[0], slip(g), "bill" if g == "william" else g])
        typed.add((rng.choice([f, f, slip(f)]), g, rng.choice(["", "", "q", "zeno"])))
    rows = [(k, [w for w in {f, *names.FULL.get(g, ())} | ({g} if len(g) > 1 else set()) | ({m} if len(m) > 1 else set())], f, [x for x in (g, m) if x]) for k, (f, g, m) in enumerate(sorted(typed))]
    df = spark.createDataFrame([(k, w, sorted(set(w) | set(g))) for k, w, _, g in rows], "node long, words array<string>, others array<string>")
    got = {tuple(r) for r in names.candidate_pairs(df).collect()}
    want = {(a, b) for a, _, fa, ga in rows for b, _, fb, gb in rows if a < b and names.compare(fa, ga, [1] * len(ga), fb, gb, [1] * len(gb))}
    assert len(want) > 300 and len(want & got) >= 0.98 * len(want)


def test_names_of_two_letters(spark):
    typed = ["Xi Wu", "X. Wu", "Wu, Xi", "Bo Li", "B. Li", "Al Ng", "A. Ng"]
    pairs = {tuple(r) for r in names.spelling_pairs(spark.createDataFrame([(n,) for n in typed], "name string")).collect()}
    assert pairs == {("Wu, Xi", "X. Wu"), ("Wu, Xi", "Xi Wu"), ("X. Wu", "Xi Wu"), ("B. Li", "Bo Li"), ("A. Ng", "Al Ng")}


def test_lcs_and_slips():
    assert names.lcs_ratio("abcd", "abxd") == 0.75 and names.lcs_ratio("", "") == 1.0
    assert all(names.one_slip(a, b) for a, b in [("abcd", "abdc"), ("abc", "abcd"), ("abc", "axc"), ("a", "a")])
    assert not any(names.one_slip(a, b) for a, b in [("abcd", "badc"), ("abc", "abcde"), ("abc", "xyc")])


def brute_alignment(a, b):
    hit, miss, gap = contamination.MATCH, contamination.MISMATCH, contamination.OPEN
    m, n, never = len(a), len(b), (-(10**6), 0)
    h = [[(0, 0)] * (n + 1) for _ in range(m + 1)]
    e = [[never] * (n + 1) for _ in range(m + 1)]
    f = [[never] * (n + 1) for _ in range(m + 1)]
    best = (0, 0)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(e[i][j - 1], (h[i][j - 1][0] + gap, h[i][j - 1][1]))
            f[i][j] = max(f[i - 1][j], (h[i - 1][j][0] + gap, h[i - 1][j][1]))
            s, k = h[i - 1][j - 1]
            h[i][j] = max((0, 0), (s + hit, k + 1) if a[i - 1] == b[j - 1] else (s + miss, k), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    rng = random.Random(8)
    pairs = []
    for _ in range(80):
        a = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        b = a[: rng.randrange(40)] + [rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] + a[rng.randrange(30) :]
        pairs.append((np.array(a), np.array(b)))
    assert contamination.align(pairs) == [brute_alignment(a.tolist(), b.tolist()) for a, b in pairs]


ITEM = "The retired mason Byrobul photographed 52 copper beehives as Krevak and Kipet had agreed, and a cellist at Lulekim first borrowed five compasses, then sorted one turbine."
ITEM_KO = "은퇴한 유리공 Skyfogir은 사다리 372개가 떨어질 때까지 rabrak 종 하나를 나누었다. 직공 몰래 bunus 조합의 잠수부이 방석 하나를 쌓았다."
FILL = "Our second baseline ignores the noisy reader histories in the last nine runs. " * 6


@pytest.mark.parametrize("blocks", [None, 1])
def test_leaks(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(contamination, "BLOCK_ITEMS", blocks)
    first, second = ITEM[:85], ITEM[85:]
    docs = {
        1: FILL + ITEM, 2: ITEM.upper().replace(",", "").replace(" ", "  "), 3: FILL + first + FILL + second, 4: ITEM.replace("copper", "golden").replace("first", "(sic) once"),
        5: FILL + ITEM[:30], 6: FILL, 7: None, 8: "", 9: second + FILL + first, 10: ITEM.replace("o", "ö"), 11: FILL + ITEM[: len(ITEM) * 3 // 5], 12: ITEM_KO, 13: ITEM + ITEM_KO, 14: FILL + ITEM_KO[:20],
        15: FILL * 300 + ITEM,
    }
    rows = list(docs.items()) + [(1, docs[1])]
    items = [(1, ITEM), (2, ITEM_KO), (3, None), (4, ""), (5, "short"), (None, ITEM), (1, "older")]
    got = contamination.leaks(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id"))
    got = sorted((r["doc_id"], r["item_id"]) for r in got.collect())
    # both halves of document 9 are there, but only one of them is in order
    half = [(9, 1)] if len(plain(second)) * 2 >= len(plain(ITEM)) or len(plain(first)) * 2 >= len(plain(ITEM)) else []
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), *half, (10, 1), (11, 1), (12, 2), (13, 1), (13, 2), (15, 1)])


def test_a_partial_copy_in_many_documents_is_found(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(40)]
    edited = [w if k not in (3, 9, 15, 22, 28, 35) else "qqqqq" for k, w in enumerate(words)]
    docs = [(0, " ".join(words))] + [(k, FILL + " ".join(edited)) for k in range(1, 61)] + [(61, FILL)]
    got = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(61))


WORDS = ITEM.split()


@pytest.mark.parametrize("every, found", [(4, True), (5, True), (7, True), (2, False)])
def test_where_the_line_of_changed_words_lies(spark, every, found):
    rng = random.Random(every)
    edited = " ".join("".join(rng.choice("qzxjvw") for _ in w) if k % every == 1 else w for k, w in enumerate(WORDS * 2))
    got = contamination.leaks(spark.createDataFrame([(1, FILL + edited + FILL)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(WORDS * 2))], "item_id long, text string"))
    assert bool(got.collect()) == found


def test_edited_copies_are_found_wherever_they_stand_and_in_pieces(spark):
    rng = random.Random(31)
    thirds = [" ".join(WORDS[k::1][:9]) for k in (0, 9, 18)]
    far = ["".join(rng.choice("abcdefghij ") for _ in range(4000)) for _ in range(4)]
    docs = [(1, far[0] + thirds[0] + far[1] + thirds[1] + far[2] + thirds[2] + far[3]), (2, far[0] + thirds[2] + far[1] + thirds[1] + far[2] + thirds[0]), (3, " ".join(w + " (um)" * (k % 4 == 3) for k, w in enumerate(WORDS)))]
    got = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert {r["doc_id"]: round(r["share"], 2) for r in got.collect()}.keys() == {1, 3}


def test_long_items_keep_score_and_matches_apart():
    rng = np.random.default_rng(5)
    a = rng.integers(97, 120, 70_000)
    assert contamination.align([(a, a[:200])]) == [(200, 200)]
    assert contamination.align([(a[:20_000], a[5000:5100])]) == [(100, 100)]


def test_the_needed_seeds_are_a_bound(spark):
    rng = random.Random(32)
    for _ in range(200):
        m, n = rng.randrange(60, 400), contamination.LONG
        item = [rng.random() for _ in range(m)]
        breaks = rng.randrange(0, max(1, m // contamination.BREAK[n]))
        cut = set(rng.sample(range(m), breaks))
        copy = [x if k not in cut else -1.0 for k, x in enumerate(item)]
        grams = {tuple(item[k : k + n]) for k in range(m - n + 1)} & {tuple(copy[k : k + n]) for k in range(m - n + 1)}
        assert len(grams) >= contamination.seeds_needed(m - breaks, n, 1.0) or breaks * contamination.BREAK[n] > m - breaks


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination.leaks(docs, items).count() == 0
    assert contamination.leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items).count() == 0


TEXTS = [
    ["The mean is approx. 13.5 ms.", "See Fig. 3 and No. 7, p. 9.", "“Does it scale?” asked J. Doe.", "It does!"],
    ['"It works!" the notes say, "on most folds."', "We drop stop words, etc.", "The U.S. pilot (really?) was left out.", "Wait... is it?"],
    ["Manche Felder, z. B. die Themen, fehlen.", "Am 6. Mai war Schluss.", "„Reicht das?“, fragte sie.", "Jeder 11. Pförtner schlief."],
    ["Selon M. Stokis, le journal suit.", "« Oui. »", "La valeur passe de 3,5 à 4."],
    ["Véase la pág. 305.", "¿Por qué mejora?", "«No», anota el Sr. Gehel."],
    ["سجل القراءة يفسر.", "لماذا يكمل؟", "يرى د. Bradras أن العدد كاف."],
    ["समीक्षक ने पूछा, \"क्या यह काफी है?\"", "डॉ. Brahim के अनुसार ठीक है।", "मान 3.5 हो गया।"],
    ['검토자는 "정말 충분한가?"라고 물었다.', "값이 2.66로 올랐다."],
]
TIGHT = [
    ["他说：“这样够吗？”", "数值从2.5升到3。", "他们说“不够好！”，但改进了。", "好！"],
    ["「これ。」とA氏は書いた。", "次の値は3.5だ。", "なぜか？", "驚いた！"],
]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences_with_blanks(text):
    for joint in (" ", "  ", "\n\n", "\r\n\r\n"):
        body = joint.join(text)
        assert [body[a:b] for a, b in sentences.split_text(body)] == text


@pytest.mark.parametrize("text", TIGHT)
def test_sentences_without_blanks(text):
    body = "".join(text)
    assert [body[a:b] for a, b in sentences.split_text(body)] == text


def test_lines():
    cases = {
        "1. Intro\n\nThis line is\nwrapped here. And\nmore of it.\n- item one\n- item two\n": ["1. Intro", "This line is\nwrapped here.", "And\nmore of it.", "- item one", "- item two"],
        "ดีมาก ทดสอบ 22 รอบ เป็น ABC ดี\nใหม่": ["ดีมาก", "ทดสอบ 22 รอบ", "เป็น ABC ดี", "ใหม่"],
        "It ended.Then it went on at data.x.example/v3 and ended.": ["It ended.", "Then it went on at data.x.example/v3 and ended."],
        "  \n\t ": [], "": [], "no mark": ["no mark"],
    }
    for body, want in cases.items():
        assert [body[a:b] for a, b in sentences.split_text(body)] == want
    assert sentences.split_text(None) == []


@pytest.mark.parametrize("marks", ["“”", '""', "„“", "«»", "()"])
@pytest.mark.parametrize("n", [2, 3, 10, 100])
def test_a_quotation_of_many_sentences_is_one(marks, n):
    quoted = marks[0] + " ".join(f"The mill number {k} stood still for a week." for k in range(n)) + marks[1]
    for text in ([f"She said: {quoted}", "The wheel turned again."], ["It was late.", f"{quoted} was all she said.", "The wheel turned again."]):
        body = " ".join(text)
        assert [body[a:b] for a, b in sentences.split_text(body)] == text


def test_marks_without_a_partner_hold_nothing_together():
    for text in (["A beam of 5\" was cut.", "It fit.", "So did the next."], ["“The first page is lost.", "The second is not.", "Nor is the third."], ["See item b) of the list.", "It is short.", "(Or so it seems."]):
        body = " ".join(text)
        assert [body[a:b] for a, b in sentences.split_text(body)] == text


def test_a_sentence_may_be_as_long_as_its_text():
    wrapped = "The list goes on and" + "\non with one more clause and" * 500 + " ends."
    assert sentences.split_text(wrapped) == [(0, len(wrapped))]
    many = "etc. and so on " * 20_000
    assert len(sentences.split_text(many)) == 1


def brute_cover(text, start, end, cuts, headings):
    places = [start, *sorted(cuts), end]
    quoted = sentences.quotations(text, start, end)
    inside = [any(a < p <= b for a, b in quoted) for p in places]
    best = [(0.0, [])] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            score = best[i][0] + sentences._length_score(places[j] - places[i]) + cuts.get(places[j], 0.0)
            score -= sentences.INSIDE * (inside[i] + inside[j])
            if places[j] in headings and sentences._first_letter(text, places[i], end) == headings[places[j]]:
                score += sentences.HEADING
            options.append((score, best[i][1] + [places[j]]))
        best[j] = max(options, key=lambda x: x[0])
    return best[-1]


def test_the_best_cover_against_brute_force():
    rng = random.Random(21)
    for _ in range(300):
        n = rng.randrange(8, 400)
        text = "".join(rng.choice(["a", "b", " ", '"', "(", ")", "\n"]) for _ in range(n))
        places = sorted(rng.sample(range(1, n), rng.randrange(1, 7)))
        cuts = {p: rng.choice([sentences.NEVER, -4.0, -1.0, -0.1, 0.0, 0.2, 0.8, 1.5, 3.0, 6.0, 12.0]) for p in places}
        headings = {p: sentences._first_letter(text, q, n) for q, p in zip([0, *places], places) if rng.random() < 0.2}
        got = sentences._best_cover(text, 0, n, cuts, headings)
        score, want = brute_cover(text, 0, n, cuts, headings)
        if got != want:  # only where both are worth the same
            again = brute_cover(text, 0, n, {p: cuts[p] for p in got[:-1]}, {p: h for p, h in headings.items() if p in got})
            assert abs(again[0] - score) < 1e-9


def test_spans_are_ordered_and_cover_all_but_blanks():
    rng = random.Random(9)
    for _ in range(300):
        body = "".join(rng.choice(["a", "B", " ", "\n", ".", "!", "“", "”", '"', "。", "日", "ก", "1", "(", ")", "«", " »", "Dr.", "\r\n", " "]) for _ in range(rng.randrange(0, 60)))
        spans = sentences.split_text(body)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(body[a:b].split()) for a, b in spans) == "".join(body.split())


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A one. B two."), (2, None), (3, ""), (None, "Only."), (1, "Again."), (4, "Long text. " * 20_000)], "doc_id long, text string").selectExpr("*", "0 as start_char")
    got = sentences.sentences(df)
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {1: 3, None: 1, 4: 20_000} and got.columns == ["doc_id", "start_char", "end_char"]
    assert sentences.sentences(df.limit(0)).count() == 0
