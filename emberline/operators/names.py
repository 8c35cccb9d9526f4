"""Proper-name tests: is a candidate the name of a company, product or person rather than a term?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import let, title_case_share, without_feed_tail
from emberline.operators.mentions import at_slot, head_filter
from emberline.sources.stores import checkpointed

LEAST_LETTERS, TITLE_CASE, ALIKE, MOST_WORDS = 5, 0.7, 0.8, 4
#: Letters of a key up to which spellings() looks for them one after another.
MOST_LETTERS = 300


def glued(text: Column) -> Column:
    """Latin letters and digits of a spelling, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def judged_text(title: Column, abstract: Column) -> Column:
    """What spellings are judged by: the abstract without its feed tail, and the title unless most of its words are capitalised."""
    plain = F.when(F.coalesce(title_case_share(title) >= TITLE_CASE, F.lit(False)), F.lit("")).otherwise(F.coalesce(title, F.lit("")))
    return F.concat_ws("\n", without_feed_tail(F.coalesce(abstract, F.lit(""))), plain)


def proper_names(text: Column) -> Column:
    """array<struct<key, words>>: runs of capitalised words inside a sentence, which acronyms may continue; of single words
    those in mixed case. A sentence's first word starts no run. Words without a capital only end runs, so neighbours of that
    kind are put together first."""
    punctuation = "[,.;:()\"'«»“”’]"
    text = F.regexp_replace(text, r"(?<!\S)[^\s\p{Lu}.!?][^\p{Lu}.!?\n]*(?=\s)", "|")

    def marked(sentence: Column) -> Column:
        def mark(token: Column, i: Column) -> Column:
            word = F.regexp_replace(F.regexp_replace(token, f"^{punctuation}+|(?<!{punctuation}){punctuation}+$", ""), "['’]s$", "")
            acronym = (word == F.upper(word)) & word.rlike(r"\p{Lu}")
            return F.when((i > 0) & word.rlike(r"^\p{Lu}") & ~acronym, F.concat(F.lit("C:"), word)).when(acronym & (F.length(word) > 1), F.concat(F.lit("A:"), word)).otherwise("|")

        return F.array_join(F.transform(F.split(F.trim(sentence), r"\s+"), mark), " ")

    runs = F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: F.regexp_extract_all(F.concat(marked(s), F.lit(" ")), F.lit(r"(C:[^ |]+ (?:[CA]:[^ |]+ )*+)"), 1)))  # possessive: else each word of a run takes a frame of the stack
    parts = F.transform(runs, lambda r: F.filter(F.split(F.regexp_replace(r, r"[CA]:", ""), " "), lambda w: w != ""))
    kept = F.filter(parts, lambda w: (F.size(w) >= 2) | w[0].rlike("[a-z]+[A-Z]|[A-Z][a-z0-9]+[A-Z]"))
    return F.transform(kept, lambda w: F.struct(glued(F.array_join(w, "")).alias("key"), F.size(w).alias("words")))


def spellings(text: Column, key: Column) -> Column:
    """How a key's letters are spelled in a text: with spaces, hyphens or nothing between; not in addresses or after @."""
    gap = r"[\s_-]?"
    # each letter of a pattern takes a frame of the stack, so a long one goes as groups that are matched for themselves
    groups = F.regexp_replace(F.substr(key, F.lit(2)), "[a-z0-9]{1,100}", "(?>$0)")
    nested = F.regexp_replace(groups, r"(?:\(\?>[a-z0-9]{1,100}\)){1,100}", "(?>$0)")
    long = F.concat(F.substr(key, F.lit(1), F.lit(1)), F.regexp_replace(nested, "[a-z0-9]", r"[\\s_-]?$0"))
    letters = F.when(F.length(key) <= MOST_LETTERS, F.array_join(F.split(key, ""), gap)).otherwise(long)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_@/.])("), letters, F.lit(r")(?![\p{L}\p{N}_]|\.[\p{L}\p{N}_])"))
    return F.regexp_extract_all(text, F.concat(F.lit("(?i)"), pattern), 1)


def capitalised(spelling: Column) -> Column:
    words = F.filter(F.split(spelling, r"[\s_-]+"), lambda w: w != "")
    return F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~F.forall(words, lambda w: w == F.upper(w))


def lower_case_keys(docs: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """The keys (key) that some text spells with a lower-case first letter, by a join on glued n-grams.

    A row is a word that begins in lower case with the next ones. It goes on if a filter of fixed size lets its letters begin a
    key, and its n-grams if another lets them be one."""
    wanted = checkpointed(keys.select("key").distinct())
    begins = F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.xxhash64(F.substring(F.col("key"), F.lit(1), n)))
    begin = head_filter(wanted.select(F.explode(begins).alias("head")))
    taken = head_filter(wanted.select(F.xxhash64("key").alias("head")))
    marked = F.regexp_replace(F.translate(text, "\x01", " "), r"(?<![\p{L}\p{N}])(?=\p{Ll})", "\x01")  # what begins in lower case
    marked = F.regexp_replace(F.lower(F.regexp_replace(marked, r"[^\p{L}\p{N}\x01]+", " ")), r"\P{ASCII}+", "")  # what is left of ASCII are letters, digits and spaces
    w = docs.select(F.split(marked, " ").alias("m"), F.split(F.translate(marked, "\x01", ""), " ").alias("w0"))
    later = [F.slice("w0", F.lit(n + 1), F.greatest(F.size("w0"), F.lit(1))).alias(f"w{n}") for n in range(1, MOST_WORDS)]
    rows = w.select(F.inline(F.arrays_zip("m", "w0", *later)))
    rows = rows.where(F.startswith("m", F.lit("\x01")) & at_slot(begin, F.xxhash64("w0")))
    grams = [F.concat("w0", *[F.coalesce(f"w{n}", F.lit("")) for n in range(1, k)]) for k in range(1, MOST_WORDS + 1)]
    each = rows.select(F.explode(F.array(*grams)).alias("key"))
    return each.where(at_slot(taken, F.xxhash64("key"))).join(wanted, "key", "left_semi").distinct()


def longest_block(a: Column, b: Column) -> Column:
    """struct(n, i, j): the longest run of letters that both words hold and where it begins in each, counted from 1; of equal
    ones the first in a, then in b. Null if they share no letter."""
    n = F.length(a)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(k.alias("n"), (-i).alias("i"), F.substr(a, i, k).alias("run")))))
    best = F.array_max(F.filter(runs, lambda r: F.instr(b, r["run"]) > 0))
    return let(best, lambda r: F.when(r.isNotNull(), F.struct(r["n"].alias("n"), (-r["i"]).alias("i"), F.instr(b, r["run"]).alias("j"))))


def matched_letters(a: Column, b: Column) -> Column:
    """How many letters two words have in matching blocks: the longest one, then those on its left and right by the same rule.
    A fold over a stack of open stretches; each step closes one, and no more than 2 * length + 1 ever open."""
    stretch = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def step(s: Column, _: Column) -> Column:
        top, rest = F.try_element_at(s["open"], F.lit(-1)), F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))

        def split(r: Column) -> Column:
            left = stretch(F.substr(top["x"], F.lit(1), r["i"] - 1), F.substr(top["y"], F.lit(1), r["j"] - 1))
            right = stretch(F.substr(top["x"], r["i"] + r["n"]), F.substr(top["y"], r["j"] + r["n"]))
            both = F.filter(F.array(left, right), lambda p: (p["x"] != "") & (p["y"] != ""))
            return F.when(r.isNull(), F.struct(rest.alias("open"), s["n"].alias("n"))).otherwise(F.struct(F.concat(rest, both).alias("open"), (s["n"] + r["n"]).alias("n")))

        return F.when(F.size(s["open"]) == 0, s).otherwise(let(longest_block(top["x"], top["y"]), split))

    start = F.struct(F.filter(F.array(stretch(a, b)), lambda p: (p["x"] != "") & (p["y"] != "")).alias("open"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)) + 1), start, step)["n"]


def shared_letters(a: Column, b: Column) -> Column:
    """How many letters two words share in any order: a bound of the matched ones."""
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))


def alike(a: Column, b: Column) -> Column:
    """Whether twice the matched letters are at least ALIKE of all letters. Two bounds come first, so that few pairs are aligned."""
    size = F.length(a) + F.length(b)
    enough = lambda n: F.lit(2.0) * n / size >= ALIKE
    return F.when(size == 0, True).when(~enough(F.least(F.length(a), F.length(b))), False).when(~enough(shared_letters(a, b)), False).otherwise(enough(matched_letters(a, b)))


def capital_words(text: Column) -> Column:
    """The distinct capitalised words of a text, glued."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z][\p{L}\p{N}_.]+)"), 1), glued))


def misspelt(candidates: DataFrame) -> DataFrame:
    """(id): one-word candidates (id, key, capitals: capital_words() of a text) that are nearly one of those words. Each two
    words are compared once, however many candidates have them."""
    pairs = candidates.where(F.length("key") >= LEAST_LETTERS).select("id", "key", F.explode("capitals").alias("w")).where("w <> ''")
    a, b = F.length("key"), F.length("w")
    pairs = checkpointed(pairs.where(F.lit(2.0) * F.least(a, b) / (a + b) >= ALIKE).distinct())
    # written before and after, else the optimizer compares below distinct() and on the other side of the join too
    near = checkpointed(checkpointed(pairs.select("key", "w").distinct()).where(alike(F.col("key"), F.col("w"))))
    return pairs.join(near, ["key", "w"], "left_semi").select("id").distinct()


def proper_candidates(candidates: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates (id, name) with is_proper. links: (id, doc_id); docs: (doc_id, title, text).

    Proper is a name that its documents spell with capitals only and no text of several words in lower case; one that holds
    such a name of its documents; a one-word name that nearly is a capitalised word there. Acronyms never are. A document's
    text is read once for each of its candidates; what is written down are the few words that were found in it.
    """
    words = F.filter(F.split("name", r"[\s_-]+"), lambda w: w != "")
    c = candidates.select("id", "name", glued(F.col("name")).alias("key"), F.size(words).alias("words"), F.forall(words, lambda w: w == F.upper(w)).alias("acronym"))
    text = docs.select("doc_id", judged_text(F.col("title"), F.col("text")).alias("text"))
    own = c.where("not acronym and key <> ''").join(links, "id").join(text, "doc_id").select("id", "key", "words", "text", spellings(F.col("text"), F.col("key")).alias("spelled"))
    inner = F.filter(proper_names(F.col("text")), lambda n: (F.length(n["key"]) >= LEAST_LETTERS) & F.contains(F.col("key"), n["key"]))
    unlike = (F.size("spelled") == 0) & (F.col("words") == 1) & (F.length("key") >= LEAST_LETTERS)
    told = own.select("id", "key", "words", (F.size("spelled") > 0).alias("seen"), F.forall("spelled", capitalised).alias("capitals"), F.array_distinct(inner).alias("inner"), F.when(unlike, capital_words(F.col("text"))).alias("near"))
    told = checkpointed(told)
    seen = told.where("seen").groupBy("id", "key", "words").agg(F.bool_and("capitals").alias("capitals"))
    held = told.select("id", F.explode("inner").alias("n")).select("id", "n.key", "n.words").distinct()
    asked = checkpointed(seen.where("capitals").select("id", "key", "words").union(held).distinct())
    lower = lower_case_keys(docs, asked.where("words > 1")).withColumn("lower", F.lit(True))
    by_spelling = asked.join(lower, "key", "left").where((F.col("words") == 1) | F.col("lower").isNull()).select("id")
    single = told.where("near is not null").join(seen.select("id"), "id", "left_anti").select("id", "key", F.col("near").alias("capitals"))
    proper = by_spelling.union(misspelt(single)).distinct().withColumn("is_proper", F.lit(True))
    return candidates.join(proper, "id", "left").withColumn("is_proper", F.coalesce("is_proper", F.lit(False)))
