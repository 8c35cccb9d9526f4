"""Text and name functions as Column expressions: keys, hosts, slugs, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import wordlists as L

WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, although body names it more than once or inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _in(x: Column, values: list[str]) -> Column:
    return x.isin(*values)


def host(url: Column) -> Column:
    """Lower-cased host of a URL without www. and port; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def unwrapped(url: Column, parameter: str = "url") -> Column:
    """The target in a redirect link's query parameter, or the link itself."""
    got = F.nullif(F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(got), url)


def title_key(title: Column) -> Column:
    """Lower-cased title with every run outside a-z, а-я, 0-9 as one space. Accents and ё part words."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-zа-я0-9]+", " "))


def dedupe_key(url: Column, title: Column) -> Column:
    """DOI links by their DOI, all else by the title key."""
    return F.when(url.contains("doi.org/"), F.regexp_replace(F.lower(url), r"^https?://(dx\.)?doi\.org/", "")).otherwise(title_key(title))


def url_id(url: Column) -> Column:
    return F.concat(host(url), F.lit(":"), F.substr(F.sha1(url), F.lit(1), F.lit(12)))


def summary(html: Column) -> Column:
    """Tags out, white space squeezed, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def without_feed_tail(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)The post .* appeared first on .*$", ""))


def feed_date(text: Column) -> Column:
    """RFC-2822 or ISO dates; what is neither is null. The weekday goes first, its pattern letter is refused."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(bare, r"\s(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.to_date(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z"))), F.to_date(F.try_to_timestamp(F.substr(text, F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd"))))


def from_inverted(index: Column) -> Column:
    """A text from map<word, positions>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def singular(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return (
        F.when((n <= 3) | word.rlike("(ss|us|is|ics)$"), word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(ches|shes|xes|sses)$"), cut(2))
        .when(word.endswith("s"), cut(1))
        .otherwise(word)
    )


def slug(name: Column) -> Column:
    """Lower-cased words without other marks, joined by hyphens, the last one singular."""
    words = F.filter(F.transform(F.split(F.lower(F.replace(name, F.lit("-"), F.lit(" "))), r"\s+"), lambda w: F.regexp_replace(w, rf"[^\p{{L}}\p{{N}}_+]+", "")), lambda w: w != "")
    last = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, singular(w)).otherwise(w))
    return F.array_join(last, "-")


def unslug(name: Column) -> Column:
    """Names written with two or more hyphens and no space get spaces; so do underscores."""
    spaced = F.when((F.size(F.split(name, "-")) > 2) & ~name.contains(" "), F.replace(name, F.lit("-"), F.lit(" "))).otherwise(name)
    return F.replace(spaced, F.lit("_"), F.lit(" "))


def stem(word: Column) -> Column:
    """The first of the endings that leaves four letters is cut; -ies becomes y."""
    w = F.lower(word)
    out = w
    for ending in reversed(["ization", "isation", "ics", "ing", "ies", "es", "s"]):
        left = F.substr(w, F.lit(1), F.length(w) - len(ending))
        out = F.when(w.endswith(ending) & (F.length(w) - len(ending) >= 4), F.concat(left, F.lit("y")) if ending == "ies" else left).otherwise(out)
    return out


def key_words(name: Column) -> Column:
    """Distinct stems of the words of more than two letters that aren't stop words after stemming."""
    words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~_in(stem(w), L.KEY_STOPS))
    return F.array_distinct(F.transform(words, stem))


def name_from_title(title: Column) -> Column:
    first = F.get(F.split(title, r"[:;,.—–()\[\]]"), F.lit(0))
    words = F.filter(F.split(F.trim(first), r"\s+"), lambda w: (w != "") & ~_in(F.lower(w), L.TITLE_STOPS))
    return F.array_join(F.slice(words, 1, 3), " ")


def without_generic_tail(name: Column) -> Column:
    """The name without a generic last word if two words stay, else null."""
    words = F.split(F.trim(name), r"\s+")
    return F.when((F.size(words) >= 3) & _in(F.lower(F.element_at(words, -1)), L.GENERIC_TAILS), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def title_case_share(text: Column) -> Column:
    """Share of the words that begin with a capital; null without words."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)
    return F.try_divide(F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))), F.size(words))


def twin_key(phrase: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(phrase)), r"\s+"), lambda w: (w != "") & ~_in(w, L.FUNCTION_WORDS))
    return F.array_join(F.array_sort(words), " ")


def companies(cell: Column) -> Column:
    """Names of a company cell: four letters at least, none in Cyrillic."""
    names = F.transform(F.split(cell, r"[,;/+()]|\s[-–—]\s"), lambda x: F.btrim(x, F.lit(" .'\"«»")))
    return F.filter(names, lambda x: (F.length(x) > 3) & ~has_cyrillic(x))


def is_big_company(name: Column) -> Column:
    """The name is, or begins with, one of the big companies."""
    n = F.concat(F.lower(name), F.lit(" "))
    return F.exists(F.array(*[F.lit(b + " ") for b in L.BIG_COMPANIES]), lambda b: F.startswith(n, b))


def within_years(published: Column, as_of: Column, years: int) -> Column:
    """Published in the last years; pushed down to the scan where both are plain columns."""
    return published >= F.date_sub(as_of, 365 * years)


def display_name(name: Column, local: Column) -> Column:
    """The name in the reader's language, if there is one."""
    return F.coalesce(F.nullif(F.trim(local), F.lit("")), name)


def has_placeholder(phrase: Column) -> Column:
    """The phrase has an angle bracket or a numbered stand-in such as "phrase 1"."""
    return F.contains(phrase, F.lit("<")) | F.contains(phrase, F.lit(">")) | F.lower(phrase).rlike(L.PLACEHOLDER)


def stage(text: Column) -> Column:
    """The stage whose keyword comes first in the part before the arrow; ties by the stage's name."""
    part = F.lower(F.get(F.split(text, "→"), F.lit(0)))
    at = [F.struct(F.instr(part, k).alias("at"), F.lit(s).alias("s")) for s, keys in L.STAGES.items() for k in keys]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["s"]


def link_targets(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"\]\((https?://[^)\s]+)\)"), 1)


def looks_like_product(name: Column) -> Column:
    """A version number, a trailing -N, or a capitalised word that is no acronym after the first."""
    rest = F.slice(F.split(F.trim(name), r"\s+"), 2, 100)
    return name.rlike(r"(^|[^\p{L}\p{N}_-])\d+(\.\d+)?($|[^\p{L}\p{N}_-])") | name.rlike(r"-\d+$") | F.exists(rest, lambda w: w.rlike(r"^\p{Lu}") & (w != F.upper(w)))


def generic_head(name: Column) -> Column:
    return _in(F.lower(F.element_at(F.split(F.trim(name), r"[\s-]+"), -1)), L.GENERIC_HEADS)


def usable_name(name: Column) -> Column:
    n = F.size(F.split(F.trim(name), r"\s+"))
    broad = _in(F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit(" ")), L.TOO_BROAD_NAMES)
    return n.between(1, 4) & ~broad & ~looks_like_product(name) & ~generic_head(name) & name.rlike(r"\p{L}")


def is_own_company(name: Column, company: Column) -> Column:
    return F.coalesce((F.length(letters(company)) >= 5) & letters(name).contains(letters(company)), F.lit(False))


def fresh_phrase(phrase: Column) -> Column:
    p = F.lower(F.trim(phrase))
    out = F.lit(False)
    for tail in L.FRESH_TAILS:
        out = out | p.endswith(tail)
    return out


def startup_news(title: Column) -> Column:
    return title.rlike("(?i)" + L.STARTUP_NEWS)


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яёА-ЯЁ]")


def self_published(url: Column) -> Column:
    h = host(url)
    doi = F.regexp_extract(F.lower(url), r"^https?://(?:dx\.|www\.)?doi\.org/([^/]+)/", 1)
    out = h.isin("doi.org", "dx.doi.org") & doi.isin(*L.SELF_PUBLISHED_DOI)
    for s in L.SELF_PUBLISHED_HOSTS:
        out = out | (h == s) | h.endswith("." + s)
    return F.coalesce(out, F.lit(False))


def mentions(text: Column, phrase: Column) -> Column:
    """The phrase occurs as whole words, whatever the case; hyphens belong to words."""
    quoted = F.regexp_replace(F.lower(phrase), r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.rlike(F.lower(text), F.concat(F.lit(r"(^|[^\p{L}\p{N}_-])"), quoted, F.lit(r"($|[^\p{L}\p{N}_-])")))


def grouped_number(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def reason_texts() -> Column:
    """map<feature, text>: what a reader is told of each feature of a row of the feature table (total_pubs, pubs_last_year,
    growth_3y, recent_share, first_seen_year, news_total, news_recent, news_to_science_ratio, has_wikipedia, preprint_share).

    Counts are grouped by threes, absent ones said to be so; absent shares, growth and ratios read as 0, an absent
    first year as such; percentages and ratios are rounded half to even, by the exact value of the double."""
    count = lambda c: F.coalesce(grouped_number(F.floor(F.col(c)).cast("bigint")), F.lit(L.NO_DATA))
    percent = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)) * 100).cast("bigint").cast("string")
    value = {
        "log_total_pubs": count("total_pubs"),
        "log_pubs_last_year": count("pubs_last_year"),
        "growth_3y": percent("growth_3y"),
        "recent_share": percent("recent_share"),
        "age_years": F.coalesce(F.col("first_seen_year").cast("string"), F.lit(L.NO_DATA)),
        "log_news_total": count("news_total"),
        "log_news_recent": count("news_recent"),
        "news_to_science": F.replace(F.format_number(F.coalesce(F.col("news_to_science_ratio").cast("double"), F.lit(0.0)), 2), F.lit(","), F.lit("")),
        "preprint_share": percent("preprint_share"),
    }
    made = []
    for name, text in L.REASON_TEXTS.items():
        head, tail = text.split("{}")
        made += [F.lit(name), F.concat(F.lit(head), value[name], F.lit(tail))]
    yes, no = L.WIKIPEDIA_TEXTS[True], L.WIKIPEDIA_TEXTS[False]
    made += [F.lit("has_wikipedia"), F.when(F.coalesce(F.col("has_wikipedia"), F.lit(False)), yes).otherwise(no)]
    return F.create_map(*made)


#: The reader's feature for each input of the heuristic score.
TOLD_AS = {"total_pubs": "log_total_pubs", "first_seen_year": "age_years", "news_to_science_ratio": "news_to_science"}


def confidence(score: Column) -> Column:
    return F.when(score > 0.75, "high").when(score > 0.5, "medium").when(score.isNotNull(), "low")


def trust_rank(level: Column) -> Column:
    return F.when(level == "high", 1).when(level == "medium", 2).when(level == "low", 3)


def failure_reason(detail: Column) -> Column:
    status = F.nullif(F.regexp_extract(detail, r"\b([45]\d\d)\b", 1), F.lit(""))
    return F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status)).when(detail.rlike("(?i)time[d]?[ -]?out"), "timeout").otherwise(F.substr(detail, F.lit(1), F.lit(80)))
