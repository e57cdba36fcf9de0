"""Variant spellings of names, by suffix blocking and longest-common-subsequence ratio.

Spellings are folded and parsed into a family name and given names (or, for organisations, a bag of words). Suffixes
of every word are indexed with the initial of another word, which names that agree share. Where few names share both, they
make a block; where many do, the other word's first three letters refine it, and only what is still common then is
discarded. Whole words never are: there the other word, with any one letter left out, refines the block once more, which
no slip of a letter escapes, and an initial, or another word of two letters, meets all others that begin with it.
Pairs of a block are compared word by word by longest-common-subsequence ratio.

Links are of three kinds: all words agree; a middle name is missing; a given name is only an initial. The weaker kinds
hold where they point to one entity only, weighed after the stronger ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import trimmed
from citeloom.operators.components import components
from citeloom.session import cut_lineage, shuffle_width

#: Letters of a proper suffix at least; whole words are indexed whatever their length.
MIN_SUFFIX = 3
#: Spellings of a block; a larger block is refined.
BLOCK = 30
#: Least ratio of the longest common subsequence of two words taken for one.
RATIO = 0.66
#: Spellings in which a given name stands before it counts as a name of its own rather than a misspelling of another one,
#: unless that other one stands in FAR times as many: misspellings of a frequent name grow in number with the collection.
ESTABLISHED, FAR = 4, 20

# Titles and suffixes, particles, and words of organisations.
TITLES = frozenset("dr prof professor phd ph.d mr mrs ms sir dipl ing".split())
DEGREES = frozenset("md m.d msc m.sc bsc b.sc ba b.a ma m.a jr sr".split())  # after a comma
PARTICLES = frozenset("von van der den de la le al el di da del della dos du ter ten bin ibn zu".split())
ORGANISATION = frozenset("""
institute laboratory centre foundation university department consortium college academy society association council
agency ministry hospital company corporation school faculty group network union committee project initiative corpus
""".split())
EXPANDED = {
    "inst": "institute", "lab": "laboratory", "labs": "laboratory", "ctr": "centre", "center": "centre", "cntr": "centre",
    "fdn": "foundation", "found": "foundation", "univ": "university", "dept": "department", "dep": "department",
    "consort": "consortium", "coll": "college", "acad": "academy", "soc": "society", "assoc": "association",
    "corp": "corporation", "co": "company", "sch": "school", "fac": "faculty",
}
LINKING = frozenset("the of for and in on und fur de et".split())

# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "anthony": "tony ant", "benjamin": "ben benny", "christopher": "chris kit topher",
    "daniel": "dan danny", "dimitri": "dima mitya", "edward": "ed eddie ted ned", "eleanor": "nell ellie nora ella",
    "elizabeth": "liz beth lizzie betty eliza", "francesca": "fran franca cesca", "frederick": "fred freddie fritz",
    "gabriela": "gabi gaby", "giuseppe": "beppe pino", "gregory": "greg", "harold": "harry hal", "isabella": "bella izzy isa",
    "johannes": "hannes hans jo", "jonathan": "jon jonny", "katherine": "kate kathy katie kat", "leonard": "len leo lenny",
    "ludmila": "mila lyuda", "margaret": "meg maggie peggy", "nicholas": "nick nico", "oliver": "ollie noll",
    "patricia": "pat trish patty", "rebecca": "becky becca", "robert": "bob rob bobby robbie", "samantha": "sam sammy",
    "susanna": "sue susie sanna", "theodore": "theo ted teddy", "victoria": "vicky tori vic", "vladimir": "vova volodya",
    "william": "will bill billy liam", "yekaterina": "katya katia", "zachary": "zach zack zac", "thomas": "tom tommy",
    "michael": "mike mick", "joseph": "joe joey", "james": "jim jimmy", "richard": "rick dick rich", "charles": "charlie chuck",
    "matthew": "matt", "andrew": "andy drew", "stephen": "steve", "jennifer": "jen jenny", "maria": "mia", "natalia": "natasha",
}
FULL: dict[str, frozenset] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        FULL[_s] = FULL.get(_s, frozenset()) | {_full}

def fold(text: str) -> str:
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def tokens_of(name: str) -> tuple[list[tuple[str, bool]], int]:
    """([(folded word, is an initial)], number of words before a comma or -1), titles and particles left out."""
    name = unicodedata.normalize("NFKC", name).replace("&", " and ")
    caps = name.upper() == name
    two = len(name.split()) == 2 and "," not in name  # Al Ng: what else would be a particle is a given name
    out: list[tuple[str, bool]] = []
    comma = -1
    for part_no, part in enumerate(name.split(",")):
        here: list[tuple[str, bool]] = []
        for raw in part.split():
            if re.fullmatch(r"(?:[^\W\d_]\.-?){2,}[^\W\d_]?\.?", raw) and fold(raw.strip(".")) not in (TITLES | DEGREES if part_no else TITLES):
                here += [(c, True) for c in fold(re.sub(r"[.\-]", "", raw))]
                continue
            word = raw.strip(".'’\"()")
            bare = fold(re.sub(r"[^\w]", "", word))
            if not bare or fold(word) in TITLES or bare in TITLES or part_no and (bare in DEGREES or fold(word) in DEGREES):
                continue
            if len(bare) == 1:
                here.append((bare, True))
            elif not caps and 2 <= len(bare) <= 3 and word.isupper() and word.isalpha():
                here += [(c, True) for c in bare]
            elif bare not in PARTICLES or two:
                here.append((bare, False))
        if here and part_no and out and comma < 0:
            comma = len(out)
        out += here
    return out, comma


def is_organisation(words: list[str]) -> bool:
    return any(EXPANDED.get(w, w) in ORGANISATION for w in words) and len(words) > 2


def organisation_words(words: list[str]) -> list[str]:
    return sorted(EXPANDED.get(w, w) for w in words if w not in LINKING)


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over both lengths."""
    if a == b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def one_slip(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours swapped, makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def same_word(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 2 and max(len(a), len(b)) >= 3 and one_slip(a, b) and lcs_ratio(a, b) >= RATIO


def other_ending(a: str, b: str) -> bool:
    """Whether two words differ in a final a, e or o only, had or not had: Daniel and Daniela, Carla and Carlo are two names."""
    stem = lambda w: w[:-1] if w[-1] in "aeo" else w
    return a != b and stem(a) == stem(b)


def given_match(a: str, na: int, b: str, nb: int) -> str | None:
    """"full" (one name or its short form), "slip" (a misspelling), "initial", or None. na, nb: spellings with that name."""
    if len(a) == 1 or len(b) == 1:
        short, long = (a, b) if len(a) == 1 else (b, a)
        return "initial" if long[:1] == short or any(f[0] == short for f in FULL.get(long, ())) else None
    if a == b:
        return "full"
    fa, fb = FULL.get(a, frozenset()) | {a}, FULL.get(b, frozenset()) | {b}
    if fa & fb:
        return "full"
    known_a, known_b = (n >= ESTABLISHED and n * FAR > other or x in FULL or x in NICKNAMES for x, n, other in ((a, na, nb), (b, nb, na)))
    if not (known_a and known_b) and same_word(a, b) and not other_ending(a, b):
        return "slip"
    return None


def compare(fa: str, ga: list[str], na: list[int], fb: str, gb: list[str], nb: list[int]) -> tuple[str, int] | None:
    """(kind, score) of two persons' names: "all", "middle" or "initial", or None. A higher score agrees in more."""
    if not ga or not gb:
        return None
    slipped = fa != fb
    if slipped and not (len(fa) >= 5 and same_word(fa, fb)):
        return None
    joined_a, joined_b = "".join(ga), "".join(gb)
    if joined_a == joined_b and min(len(g) for g in ga + gb) > 1:
        return "all", 9
    if len(ga) != len(gb):  # a double name written in two words
        for long, nl, short in ((ga, na, gb), (gb, nb, ga)):
            if len(long) > len(short) and len(long) > 1 and long[0] + long[1] == short[0] and len(short[0]) > 3:
                merged, nm = [short[0], *long[2:]], [nl[0], *nl[2:]]
                return compare(fa, merged, nm, fb, gb, nb) if long is ga else compare(fa, ga, na, fb, merged, nm)
    first = given_match(ga[0], na[0], gb[0], nb[0])
    if first is None or slipped and first != "full":
        return None
    score = {"full": 2, "slip": 1, "initial": 1}[first]
    for x, nx, y, ny in zip(ga[1:], na[1:], gb[1:], nb[1:]):
        m = given_match(x, nx, y, ny)
        if m is None or slipped and m == "slip":
            return None
        score += 1
    if first == "initial":
        return "initial", score
    return ("all" if len(ga) == len(gb) else "middle"), score


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name in batch["name"]:
            parsed, comma = tokens_of(name)
            words, initials = [w for w, _ in parsed], [i for _, i in parsed]
            organisation = is_organisation(words)
            # what a word's place says: 1 family, -1 given, 0 nothing
            says = [0] * len(words)
            if not organisation and len(words) > 1:
                if comma > 0:
                    says = [1 if k < comma else -1 for k in range(len(words))]
                elif not initials[-1] and not initials[0]:
                    says[0], says[-1] = -1, 1
                elif not initials[-1]:
                    says[-1] = 1
            rows.append((name, organisation, comma, words, initials, says))
        yield pd.DataFrame(rows, columns=["name", "organisation", "comma", "words", "initials", "says"])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides on the family name, with each word's counts as given and as family name."""
    for batch in batches:
        rows = []
        for name, organisation, comma, ws in zip(batch["name"], batch["organisation"], batch["comma"], batch["ws"]):
            ws = sorted(ws, key=lambda w: w["pos"])
            words, initials = [w["word"] for w in ws], [w["initial"] for w in ws]
            if organisation:
                bag = organisation_words(words)
                rows.append((name, "organisation", " ".join(bag), [], [], bag))
                continue
            full = [k for k in range(len(words)) if not initials[k]]
            if not full:
                rows.append((name, "person", "".join(words), [], [], []))
                continue
            if comma > 0:
                family = [k for k in full if k < comma] or [full[-1]]
            else:
                lean = {k: (ws[k]["as_given"] + 0.5) / (ws[k]["as_given"] + ws[k]["as_family"] + 1.0) for k in (full[0], full[-1])}
                family = [full[-1]]
                if initials[-1] and len(full) == 1:
                    family = [full[0]]
                elif lean[full[0]] < lean[full[-1]] and (initials[-1] or lean[full[-1]] > 0.7 and lean[full[0]] < 0.6):
                    family = [full[0]]
            given = [k for k in range(len(words)) if k not in family]
            rows.append((name, "person", "".join(words[k] for k in family), [words[k] for k in given], [int(ws[k]["as_given"]) for k in given], sorted({words[k] for k in full})))
        yield pd.DataFrame(rows, columns=["name", "kind", "family", "given", "counts", "words"])


def parsed_names(names: DataFrame) -> DataFrame:
    """(name, kind, family, given, counts, words, node) of distinct spellings; node is the folded, ordered form."""
    first = cut_lineage(names.mapInPandas(_tokenise, "name string, organisation boolean, comma int, words array<string>, initials array<boolean>, says array<int>"))
    long = first.select("name", "organisation", "comma", F.posexplode(F.arrays_zip("words", "initials", "says")).alias("pos", "w")).select("name", "organisation", "comma", "pos", F.col("w.words").alias("word"), F.col("w.initials").alias("initial"), F.col("w.says").alias("says"))
    roles = long.groupBy("word").agg(F.count_if(F.col("says") < 0).alias("as_given"), F.count_if(F.col("says") > 0).alias("as_family"))
    joined = long.join(roles, "word").groupBy("name", "organisation", "comma").agg(F.collect_list(F.struct("pos", "word", "initial", "as_given", "as_family")).alias("ws"))
    parsed = joined.mapInPandas(_parse, "name string, kind string, family string, given array<string>, counts array<int>, words array<string>")
    return parsed.withColumn("node", F.concat_ws("|", F.substring("kind", 1, 1), "family", F.concat_ws(" ", "given")))


def candidate_pairs(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of nodes that share a block. nodes: (node, words, others), others the words and initials besides; and
    maybe `given`, those of the words beside which an initial says nothing of the family name, and `lead`, the first given name and its forms.

    No group is taken whole that may be larger than `block`, but those that agree in a whole word, another word's initial, its first three
    letters and all but one of its letters.
    """
    given = F.col("given") if "given" in nodes.columns else F.array().cast("array<string>")
    lead = F.col("lead") if "lead" in nodes.columns else F.col("others")
    words = nodes.select("node", "others", given.alias("given"), lead.alias("lead"), F.explode("words").alias("word")).withColumn("own", ~F.array_contains("given", F.col("word")))
    shortest = F.least(F.length("word"), F.greatest(F.lit(MIN_SUFFIX), F.ceil(F.length("word") / 2).cast("int")))
    index = words.select("node", "own", "word", "lead", F.explode("others").alias("o"), shortest.alias("k")).where("o <> word")
    index = index.select("node", (F.col("own") & F.array_contains("lead", F.col("o"))).alias("own"), "word", "o", F.explode(F.sequence("k", F.length("word"))).alias("k"))
    # a pair that agrees in the letter before the suffix too meets under the longer one
    before = F.expr("substring(word, length(word) - k, if(k < length(word), 1, 0))")
    index = index.select("node", "own", "word", F.col("k").eqNullSafe(F.length("word")).alias("whole"), before.alias("before"), F.expr("right(word, k)").alias("suffix"), F.substring("o", 1, 1).alias("one"), "o").withColumn("key", F.xxhash64("suffix", "one"))
    index = cut_lineage(index)

    def sized(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.count_distinct("node").alias("n")).where("n > 1")

    def within(rows: DataFrame) -> DataFrame:
        """Pairs of the blocks of rows (key, node, before, word), each of which is small, whose words are within two letters of each other."""
        blocks = rows.groupBy("key").agg(F.collect_set(F.struct("node", "before", "word")).alias("m"))
        pairs = blocks.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
        return pairs.where("x.node < y.node and (x.before <> y.before or x.before = '') and levenshtein(x.word, y.word, 2) >= 0").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    sizes = cut_lineage(sized(index))
    pairs = within(index.select("key", "node", "before", "word").join(sizes.where(F.col("n") <= block).select("key"), "key"))

    # what is common is refined by the other word's first three letters
    common = cut_lineage(index.join(sizes.where(F.col("n") > block).select("key"), "key").withColumnRenamed("key", "wide").withColumn("key", F.xxhash64("wide", F.substring("o", 1, 3))))
    finer = cut_lineage(sized(common))
    pairs = pairs.unionAll(within(common.select("key", "node", "before", "word").join(finer.where(F.col("n") <= block).select("key"), "key")))

    # whole words that are common: by the other word with one letter left out, so that no slip of a letter escapes
    still = common.where("whole").select("node", "wide", "o")
    left_out = F.array_distinct(F.concat(F.array("o"), F.transform(F.sequence(F.lit(1), F.length("o")), lambda i: F.concat(F.substring("o", F.lit(1), i - 1), F.substring("o", i + 1, F.length("o"))))))
    still = still.select("node", F.explode(left_out).alias("form"), "wide").select("node", F.xxhash64("wide", "form").alias("key"))
    pairs = pairs.unionAll(still.withColumnRenamed("node", "a").join(still.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b"))
    # a first given name that is an initial or of two letters meets all that begin with the same letter
    alike = common.where("whole and own").select("wide", "node", "o")
    short = alike.where(F.length("o") < 3).select("wide", F.col("node").alias("a"))
    met = short.join(alike.select("wide", F.col("node").alias("b")), "wide").where("a <> b")
    pairs = pairs.unionAll(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def _compare_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, ka, fa, ga, na, b, kb, fb, gb, nb in zip(*(batch[c] for c in ("a", "kind_a", "family_a", "given_a", "counts_a", "b", "kind_b", "family_b", "given_b", "counts_b"))):
            if ka != kb:
                continue
            if ka == "organisation":
                if _same_organisation(fa.split(), fb.split()):
                    rows.append((a, b, "all", 9))
                continue
            ga, gb = list(ga), list(gb)
            found = compare(fa, ga, list(na), fb, gb, list(nb))
            if found is None:
                continue
            kind, score = found
            # a is the less exact of the two
            exact_a, exact_b = (len(ga[0]) > 1, len(ga), sum(map(len, ga))), (len(gb[0]) > 1, len(gb), sum(map(len, gb)))
            if exact_a > exact_b:
                a, b, ga, gb = b, a, gb, ga
            rows.append((a, b, kind, score + 10 * (len(gb[0]) > 1)))
        yield pd.DataFrame(rows, columns=["a", "b", "kind", "score"])


def _same_organisation(a: list[str], b: list[str]) -> bool:
    """One bag of words, at most one of them misspelled."""
    only_a, only_b = list(a), list(b)
    for w in a:
        if w in only_b:
            only_a.remove(w)
            only_b.remove(w)
    if not only_a and not only_b:
        return True
    return len(only_a) == len(only_b) == 1 and min(len(a), len(b)) > 1 and min(len(only_a[0]), len(only_b[0])) > 3 and same_word(only_a[0], only_b[0])


def _settled(links: DataFrame, merged: DataFrame) -> DataFrame:
    """Links between components (id, component) instead of nodes."""
    for end in ("a", "b"):
        links = links.join(merged.select(F.col("id").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return links.where("a <> b")


def _only_choice(links: DataFrame) -> DataFrame:
    """The links of those a whose best-scored links lead to one b."""
    best = links.groupBy("a", "b").agg(F.max("score").alias("score"))
    top = best.groupBy("a").agg(F.max("score").alias("score"))
    top = best.join(top, ["a", "score"])
    one = top.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1")
    return one.select("a", "b")


def _linked(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, node, id) of distinct spellings and (id, component) of the nodes that are linked; ids are numbers of nodes."""
    distinct = names.select(trimmed(F.col("name")).alias("name")).where(F.col("name").isNotNull()).distinct()
    parsed = cut_lineage(parsed_names(distinct))
    # rows of a node agree in all but `words`, of which the least are taken, and of the counts of given names the greatest
    nodes = parsed.groupBy("node").agg(F.min("kind").alias("kind"), F.min("family").alias("family"), F.min("given").alias("given"), F.max("counts").alias("counts"), F.min("words").alias("words"))
    shorts = F.create_map(*[x for k, v in FULL.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in sorted(v)]))])
    forms = F.array_union(F.col("words"), F.flatten(F.transform("given", lambda g: F.coalesce(F.try_element_at(shorts, g), F.array()))))
    nodes = cut_lineage(nodes.withColumn("forms", forms).withColumn("others", F.array_union("forms", "given")).withColumn("id", F.monotonically_increasing_id()))
    # organisations and single words have no given name: any word may lead
    first = F.try_element_at("given", F.lit(1))
    lead = F.when(first.isNull(), F.col("others")).otherwise(F.array_union(F.array(first), F.coalesce(F.try_element_at(shorts, first), F.array().cast("array<string>"))))
    pairs = candidate_pairs(nodes.select(F.col("id").alias("node"), F.col("forms").alias("words"), "others", F.array_union("given", F.array_except("forms", "words")).alias("given"), lead.alias("lead")))
    sides = nodes.select("id", "kind", "family", "given", "counts", F.transform("others", lambda o: F.substring(o, 1, 1)).alias("initials"))
    for end in ("a", "b"):
        pairs = pairs.join(sides.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in sides.columns[1:]]), end)
    near = (F.col("kind_a") == F.col("kind_b")) & ((F.col("kind_a") == "organisation") | (F.levenshtein("family_a", "family_b", 2) >= 0))
    near = near & F.arrays_overlap("initials_a", "initials_b")
    links = cut_lineage(pairs.where(near).drop("initials_a", "initials_b").mapInPandas(_compare_pairs, "a long, b long, kind string, score int"))

    # stronger links first; each kind is weighed between what the kinds before it have merged
    merged = cut_lineage(components(links.where("kind = 'all'")))
    for kind in ("middle", "initial"):
        choice = cut_lineage(_only_choice(_settled(links.where(F.col("kind") == kind), merged)))
        more = components(choice)
        ids = merged.select("id", "component").unionAll(choice.select("a", "a").unionAll(choice.select("b", "b")).distinct().join(merged.select(F.col("id").alias("a")), "a", "left_anti"))
        merged = cut_lineage(ids.join(more.select(F.col("id").alias("component"), F.col("component").alias("_c")), "component", "left").select("id", F.coalesce("_c", "component").alias("component")))
    return parsed.select("name", "node").join(nodes.select("node", "id"), "node"), merged


def link_spellings(names: DataFrame) -> DataFrame:
    """(name, entity): distinct spellings, as typed and trimmed, with the least folded form of the entity they belong to.

    names: (name STRING), any number of rows per spelling; null and blank ones are left out. Spellings that are linked to
    no other are entities of their own. Very long names are compared like others. An empty table gives no rows.
    """
    spellings, merged = _linked(names)
    known = spellings.join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("node").alias("entity"))
    return known.join(least, "component").select("name", "entity")


def spelling_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: all pairs of distinct spellings of one entity. names: as for link_spellings."""
    spellings, merged = _linked(names)
    known = cut_lineage(spellings.join(merged, "id", "left").select("name", F.coalesce("component", "id").alias("component")))
    return known.withColumnRenamed("name", "name_a").join(known.withColumnRenamed("name", "name_b"), "component").where("name_a < name_b").select("name_a", "name_b")
