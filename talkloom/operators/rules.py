"""Quality heuristics as conjunctive rule sets; word lists are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import contains_any, n_words, similarity
from talkloom.operators import turns


@dataclass(frozen=True)
class DialogueRule:
    """A dialogue passes with enough turns, enough of the words the assistant's, and no banned phrase."""

    least_turns: int
    least_share: float
    banned: tuple[str, ...] = ()
    banned_endings: tuple[str, ...] = ()

    def check(self, c: Column) -> Column:
        whole = F.lower(F.concat(F.array_join(F.transform(c, lambda m: m["content"]), " "), F.lit(" ")))
        last = F.lower(F.coalesce(F.get(turns.of_role(c, "assistant"), F.size(turns.of_role(c, "assistant")) - 1)["content"], F.lit("")))
        ends = F.lit(False)
        for e in self.banned_endings:
            ends = ends | last.endswith(e)
        share = turns.assistant_share(c)
        return (F.size(c) >= self.least_turns) & F.coalesce(share >= self.least_share, F.lit(False)) & ~contains_any(whole, self.banned) & ~ends


#: Phrases that the rule sets ban (fixed values).
FRIEND = DialogueRule(4, 0.35, ("language model", "sin ", "repent", "god's plan"))
CASUAL = DialogueRule(6, 0.25, ("language model", "sin ", "repent", "god's plan", "breathe in", "breathe out", "grounding", "what do you see", "that sounds heavy", "you're not alone in this"))
TRANSITION = DialogueRule(8, 0.25, ("grounding", "breathe in", "what do you see", "breathe out", "breathing exercise", "let's do a quick"), ("lol", "haha", "😂", "lmao"))
GROUNDING = ("4-7-8", "inhale for", "breathe in", "grounding exercise", "name 5 things", "box breathing", "body scan")


def pair_ok(prompt: Column, chosen: Column, rejected: Column, category: Column, most_similar: float = 0.70, least_words: int = 8, most_ratio: float = 2.5) -> Column:
    """Whether a preference pair is usable: texts unlike enough, long enough, of comparable length."""
    a, b = n_words(chosen), n_words(rejected)
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    full = (F.size(prompt) > 0) & (F.coalesce(chosen, F.lit("")) != "") & (F.coalesce(rejected, F.lit("")) != "")
    calm = ~(category.isin("casual_sad", "transition") & contains_any(F.lower(chosen), GROUNDING))
    asked = F.exists(prompt, lambda m: m["role"] == "user")
    deep = ~((category == "mixed_mode") & (F.size(prompt) < 7))
    return full & (similarity(chosen, rejected) <= most_similar) & (a >= least_words) & (b >= least_words) & (ratio <= most_ratio) & calm & asked & deep


def mentions(text: Column, terms: Column) -> Column:
    """Whether the lower-cased text has any word of any of the terms (an array of strings)."""
    low = F.lower(text)
    parts = F.flatten(F.transform(terms, lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")))
    return F.exists(parts, lambda w: F.contains(low, w))


def recalls(text: Column, name: Column, session: Column) -> Column:
    """Whether the text has the supporter's first name, or one of the session's first eight longer words."""
    low = F.lower(text)
    first = F.lower(F.get(F.split(name, " "), 0))
    longer = F.slice(F.filter(F.split(F.lower(session), r"\s+"), lambda w: F.regexp_like(w, F.lit(r"^\p{L}{4,}$"))), 1, 8)
    return F.coalesce(F.contains(low, first), F.lit(False)) | F.exists(longer, lambda w: F.contains(low, w))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the lower-cased text."""
    low = F.lower(text)
    return sum((low.contains(k).cast("int") for k in keywords), F.lit(0))


def biometric(text: Column, keywords: list[str], kind: str, banned: tuple[str, ...] = (), most_words: int = 70, trend: tuple[str, ...] = ()) -> Column:
    """Rules for replies that may use health data.

    ``relevant`` needs a keyword, ``irrelevant`` allows one at most, ``adjacent`` needs one that does not
    open the reply (its first six words), ``trend`` also needs a word of the trend lexicon.
    """
    hits, short = keyword_hits(text, keywords), n_words(text) <= most_words
    head = F.lower(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 6), " "))
    opens = keyword_hits(head, keywords) > 0
    base = short & ~contains_any(F.lower(text), banned)
    if kind == "relevant":
        return base & (hits >= 1)
    if kind == "irrelevant":
        return base & (hits <= 1)
    if kind == "adjacent":
        return base & (hits >= 1) & ~opens
    if kind == "trend":
        return base & (hits >= 1) & contains_any(F.lower(text), trend)
    raise ValueError(f"unknown kind: {kind}")


def memory_verdict(c: Column, context: list[str], blacklist: list[str], casual: Column, needs_context: Column) -> Column:
    """keep, drop or overref: too few or bad turns drop; context must be used where asked, and not flaunted in casual modes."""
    talk = F.filter(c, lambda m: m["role"] != "system")
    replies = turns.of_role(c, "assistant")
    sizes = F.transform(replies, lambda m: n_words(m["content"]))
    whole = F.lower(F.array_join(F.transform(replies, lambda m: m["content"]), " "))
    bad = (F.size(talk) < 4) | F.forall(sizes, lambda n: n < 3) | F.exists(sizes, lambda n: n > 150) | ~F.exists(c, lambda m: m["role"] == "system")
    over = casual & (keyword_hits(whole, blacklist) >= 2)
    return F.when(bad, "drop").when(over, "overref").when(needs_context & ~contains_any(whole, context), "drop").otherwise("keep")


def crisis_ok(c: Column, banned: list[str], must: list[str], most_words: int = 90) -> Column:
    """Every reply short, none with a banned phrase, and one at least with what its mode must say."""
    replies = turns.of_role(c, "assistant")
    clean = F.forall(replies, lambda m: (n_words(m["content"]) <= most_words) & ~contains_any(F.lower(m["content"]), banned))
    whole = F.lower(F.array_join(F.transform(replies, lambda m: m["content"]), " "))
    return (F.size(replies) > 0) & clean & contains_any(whole, must)


def help_ok(c: Column, technique: list[str], probes: list[str], most_words: int = 90) -> Column:
    """The first reply is short, names a technique and does not open by probing."""
    first = F.lower(F.coalesce(F.get(turns.of_role(c, "assistant"), 0)["content"], F.lit("")))
    probe = F.lit(False)
    for p in probes:
        probe = probe | first.startswith(p)
    return (first != "") & (n_words(first) <= most_words) & contains_any(first, technique) & ~probe


def has_all(tags: Column, wanted: list[str]) -> Column:
    """Superset test."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), tags)) == 0


def rule_check(response: Column, check: Column, ends_anywhere: bool = False) -> Column:
    """One declarative check: ``struct(type, value, values, min, max)`` against a response.

    Case does not matter; lengths are characters, bounds included.  ``ends_question`` reads the
    last character, or anywhere with ``ends_anywhere``.
    """
    low, n = F.lower(response), F.length(response)
    value = F.lower(F.coalesce(check["value"], F.lit("")))
    values = F.transform(F.coalesce(check["values"], F.array().cast("array<string>")), F.lower)
    question = response.contains("?") if ends_anywhere else F.regexp_replace(response, r"(?U)\s+$", "").endswith("?")
    return (
        F.when(check["type"] == "contains", F.contains(low, value))
        .when(check["type"] == "not_contains", ~F.contains(low, value) & ~F.exists(values, lambda v: F.contains(low, v)))
        .when(check["type"] == "contains_any", F.exists(values, lambda v: F.contains(low, v)))
        .when(check["type"] == "not_starts_with_any", ~F.exists(values, lambda v: F.startswith(F.ltrim(low), v)))
        .when(check["type"] == "length", (n >= F.coalesce(check["min"], F.lit(0))) & (n <= F.coalesce(check["max"], F.lit(2**31 - 1))))
        .when(check["type"] == "ends_question", question)
    )


def targeted_pair(chosen: Column, rejected: Column, needs: Column, most_similar: float = 0.70, least_words: int = 6, most_ratio: float = 3.0, banned: tuple[str, ...] = ()) -> Column:
    """A pair whose chosen text meets ``needs``; texts unlike enough and of comparable length."""
    a, b = n_words(chosen), n_words(rejected)
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1))
    filled = (F.coalesce(chosen, F.lit("")) != "") & (F.coalesce(rejected, F.lit("")) != "")
    return filled & needs & ~contains_any(F.lower(chosen), banned) & (similarity(chosen, rejected) <= most_similar) & (a >= least_words) & (b >= least_words) & (ratio <= most_ratio)


def biometric_pair(chosen: Column, rejected: Column, kind: str, keywords: list[str], phrases: tuple[str, ...], general: tuple[str, ...] = (), banned: tuple[str, ...] = (), most_similar: float = 0.70) -> Column:
    """Opposed use of health data.  A text refers to it by a keyword or a specific phrase.

    ``recall``: the chosen text refers, the rejected one does not.  ``restraint``: the other way round.  ``intrusion``:
    the rejected text has a specific phrase or two keywords.  ``presumption``: only the rejected text overgeneralises.
    One keyword is no reference where there must be none.  The side that refers has eight words or more, the other five.
    """
    a, b = F.lower(chosen), F.lower(rejected)
    hits = lambda x: keyword_hits(x, keywords)
    refers = lambda x, least=1: (hits(x) >= least) | contains_any(x, phrases)
    sides = {
        "recall": refers(a) & ~refers(b, 2),
        "restraint": refers(b) & ~refers(a, 2),
        "intrusion": refers(b, 2) & ~refers(a, 2),
        "presumption": contains_any(b, general) & ~contains_any(a, general) & ~contains_any(a, phrases),
    }
    least = (8, 5) if kind == "recall" else (5, 8)
    filled = (F.coalesce(chosen, F.lit("")) != "") & (F.coalesce(rejected, F.lit("")) != "")
    return filled & sides[kind] & ~contains_any(a, banned) & (similarity(chosen, rejected) <= most_similar) & (n_words(chosen) >= least[0]) & (n_words(rejected) >= least[1])


def filter_scenarios(df: DataFrame, category: str | None = None, kind: str | None = None, ids: DataFrame | None = None, tags: list[str] | None = None, mobile_safe: bool = False, id_col: str = "id") -> DataFrame:
    """Scenarios that pass all filters given; without a type they are ``single``."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if kind is not None:
        df = df.where(F.coalesce("type", F.lit("single")) == kind)
    if ids is not None:
        df = df.join(ids, id_col, "left_semi")
    wanted = [*(tags or []), *["mobile_safe"] * mobile_safe]
    return df.where(has_all(F.coalesce("tags", F.array().cast("array<string>")), wanted)) if wanted else df
