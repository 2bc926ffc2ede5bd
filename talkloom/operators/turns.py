"""Turn surgery on conversations: arrays of ``struct(role, content)``, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkloom.functions.text import contains_any, n_words, strip

MESSAGE = "array<struct<role:string,content:string>>"


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def to_arrays(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", into: str = "c") -> DataFrame:
    """One row per conversation; the order comes from ``turn`` alone."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))))
    return rows.groupBy(key).agg(F.transform(packed, lambda m: message(m["role"], m["content"])).alias(into))


def to_rows(convs: DataFrame, key: str = "conv_id", c: str = "c") -> DataFrame:
    return convs.select(key, F.posexplode(c).alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def of_role(c: Column, role: str) -> Column:
    return F.filter(c, lambda m: m["role"] == role)


def drop_blank(c: Column) -> Column:
    """Contents stripped, empty turns out."""
    return F.filter(F.transform(c, lambda m: message(m["role"], strip(m["content"]))), lambda m: m["content"] != "")


def assistant_last(c: Column) -> Column:
    """Up to the last assistant turn, whatever follows it; unchanged if there is none."""
    back = F.array_position(F.transform(F.reverse(c), lambda m: m["role"]), "assistant").cast("int")
    return F.when(back > 0, F.slice(c, F.lit(1), F.size(c) - back + 1)).otherwise(c)


def merge_users(c: Column) -> Column:
    """Runs of user turns joined by newlines; other roles stay apart."""

    def step(done: Column, m: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(message(last["role"], F.concat(last["content"], F.lit("\n"), m["content"]))))
        return F.when((F.size(done) > 0) & (last["role"] == "user") & (m["role"] == "user"), joined).otherwise(F.concat(done, F.array(message(m["role"], m["content"]))))

    return F.aggregate(c, F.array().cast(MESSAGE), step)


def n_turns(c: Column) -> Column:
    """User and assistant turns; a system turn does not count."""
    return F.size(F.filter(c, lambda m: m["role"].isin("user", "assistant"))).cast("bigint")


def too_short(c: Column, least: int) -> Column:
    return n_turns(c) < least


def packable(c: Column, least: int = 4) -> Column:
    return (F.size(c) >= least) & F.exists(c, lambda m: m["role"] == "assistant")


def assistant_text(c: Column) -> Column:
    return F.array_join(F.transform(of_role(c, "assistant"), lambda m: m["content"]), " ")


def assistant_share(c: Column) -> Column:
    """Words of assistant turns among all words, system turns included; null without words."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, m: s + n_words(m["content"]))
    return F.when(total(c) > 0, total(of_role(c, "assistant")) / total(c))


def same(c: Column) -> Column:
    """A key that two conversations share only if they are equal: a digest of their JSON."""
    return F.sha2(F.to_json(c), 256)


def flat(c: Column, gap: str = "\n--\n") -> Column:
    """A conversation as one string to read; different ones may look alike."""
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("|"), m["content"])), gap)


def with_runs(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Long rows with ``user_turn`` (user turns so far) and ``run`` (number of the role's run)."""
    w = Window.partitionBy(key).orderBy("turn")
    change = (F.col("role") != F.lag("role").over(w)).cast("int")
    return (
        rows.withColumn("change", F.coalesce(change, F.lit(1)))
        .withColumn("user_turn", F.sum((F.col("role") == "user").cast("int")).over(w))
        .withColumn("run", F.sum("change").over(w))
        .drop("change")
    )


def judge_view(c: Column, scope: str) -> Column:
    """What a judge reads: all turns, all turns numbered by user turn, or the last exchange."""
    seen = F.filter(c, lambda m: m["role"] != "system")
    name = lambda m: F.when(m["role"] == "user", "User").when(m["role"] == "assistant", "AI").otherwise(m["role"])
    line = lambda m: F.concat(name(m), F.lit(": "), m["content"])
    if scope == "any_turn":
        return F.array_join(F.transform(seen, line), "\n")
    if scope == "all_turns":

        def number(a: Column, m: Column) -> Column:
            n = a["n"] + (m["role"] == "user").cast("int")
            text = F.concat(name(m), F.lit(" T"), n.cast("string"), F.lit(": "), m["content"])
            return F.struct(n.alias("n"), F.concat(a["lines"], F.array(text)).alias("lines"))

        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("lines"))
        return F.array_join(F.aggregate(seen, start, number, lambda a: a["lines"]), "\n")
    if scope != "final_turn":
        raise ValueError(f"unknown scope: {scope}")
    upto = assistant_last(seen)
    before = F.reverse(F.slice(upto, F.lit(1), F.greatest(F.size(upto) - 1, F.lit(0))))
    stop = F.array_position(F.transform(before, lambda m: (m["role"] != "user").cast("int")), 1).cast("int")
    users = F.reverse(F.slice(before, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(before))))
    lines = F.transform(F.concat(users, F.slice(upto, F.size(upto), F.lit(1))), line)
    return F.when(F.exists(seen, lambda m: m["role"] == "assistant"), F.array_join(lines, "\n")).otherwise("(no assistant turns)")


def flip_roles(c: Column, persona: Column) -> Column:
    """The user's side as the model's: roles swapped, system out, the persona before the first turn of the new user."""
    swapped = F.transform(F.filter(c, lambda m: m["role"] != "system"), lambda m: message(F.when(m["role"] == "user", "assistant").otherwise("user"), m["content"]))
    at = F.array_position(F.transform(swapped, lambda m: m["role"]), "user").cast("int") - 1
    return F.transform(swapped, lambda m, k: message(m["role"], F.when(k == at, F.concat(persona, F.lit("\n\n"), m["content"])).otherwise(m["content"])))


def sanitize(c: Column, last: int = 200, most: int = 8000) -> Column:
    """The last messages of users and assistants, each cut to ``most`` characters."""
    recent = F.slice(c, F.greatest(F.size(c) - last + 1, F.lit(1)), F.lit(last))
    kept = F.filter(recent, lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())
    return F.transform(kept, lambda m: message(m["role"], F.substring(m["content"], 1, most)))


def trim_to_budget(rows: DataFrame, budget: int, key: str = "conv_id") -> DataFrame:
    """Newest first while the token estimate (length // 4 + 6) fits; the newest always stays.

    The estimate is positive, so its running sum stops at the first turn that overflows.
    """
    talk = rows.where("role in ('user', 'assistant')")
    w = Window.partitionBy(key).orderBy(F.desc("turn"))
    cost = F.floor(F.length("text") / 4) + 6
    ranked = talk.withColumn("used", F.sum(cost).over(w)).withColumn("newest", F.row_number().over(w))
    return ranked.where((F.col("used") <= budget) | (F.col("newest") == 1)).drop("newest")


def truncate_pairs(c: Column, most: int) -> Column:
    """System turns kept, the oldest two of the rest dropped until the words fit or fewer than two are left."""
    system, rest = of_role(c, "system"), F.filter(c, lambda m: m["role"] != "system")
    size = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, m: s + n_words(m["content"]))
    drops = F.sequence(F.lit(0), F.floor(F.size(rest) / 2).cast("int"))
    tail = lambda k: F.slice(rest, 2 * k + 1, F.greatest(F.size(rest) - 2 * k, F.lit(0)))
    fits = F.filter(drops, lambda k: size(system) + size(tail(k)) <= most)
    k = F.coalesce(F.get(fits, 0), F.floor(F.size(rest) / 2).cast("int"))
    return F.transform(F.array(k), lambda n: F.concat(system, tail(n)))[0]


def chunk(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` from 0 in steps of ``size - overlap`` while a start is inside."""

    def windows(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(t, s + 1, F.lit(size)))

    return F.transform(F.array(tokens), windows)[0]  # bound, or the tokens would be made anew for every window


def dump(c: Column) -> Column:
    """``ROLE: text`` lines without system turns."""
    return F.array_join(F.transform(F.filter(c, lambda m: m["role"] != "system"), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n")


def title(c: Column) -> Column:
    """The first user message cut to 30 characters, or a default."""
    first = F.get(of_role(c, "user"), 0)["content"]
    return F.when(first.isNull(), "New Chat").when(F.length(first) > 30, F.concat(F.substring(first, 1, 30), F.lit("..."))).otherwise(first)


#: Markers of chat templates: (start of a turn, end of its header, end of the turn) (fixed values).
TEMPLATES = {
    "llama": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"),
    "qwen": ("<|im_start|>", "\n", "<|im_end|>\n"),
    "gemma": ("<|turn>", "\n", "<turn|>\n"),
}


def render(c: Column, template: str = "llama", begin: str = "") -> Column:
    head, body, end = TEMPLATES[template]
    role = lambda m: F.when((m["role"] == "assistant") & F.lit(template == "gemma"), "model").otherwise(m["role"])
    return F.concat(F.lit(begin), F.array_join(F.transform(c, lambda m: F.concat(F.lit(head), role(m), F.lit(body), m["content"], F.lit(end))), ""))


def supervised_spans(c: Column, template: str = "llama", begin: str = "") -> Column:
    """Character spans [start, stop) of a rendered conversation that training looks at.

    An assistant turn counts from the end of its header through its end marker.
    """
    head, body, end = TEMPLATES[template]
    role = lambda m: F.when((m["role"] == "assistant") & F.lit(template == "gemma"), "model").otherwise(m["role"])

    def step(a: Column, m: Column) -> Column:
        start = a["at"] + len(head) + F.length(role(m)) + len(body)
        stop = start + F.length(m["content"]) + len(end.rstrip("\n"))
        spans = F.when(m["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(a["spans"])
        return F.struct((start + F.length(m["content"]) + len(end)).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(len(begin)).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return F.aggregate(c, empty, step, lambda a: a["spans"])


#: Names that corpora give the two speakers (fixed values).
_ASSISTANT = ("sys", "supporter", "assistant", "counselor", "counsellor", "therapist", "helper")
_USER = ("usr", "seeker", "user", "client", "patient")


def map_role(raw: Column) -> Column:
    """Synonyms of speakers as assistant or user; anything else is null."""
    x = F.lower(strip(raw))
    return F.when(x.isin(*_ASSISTANT), "assistant").when(x.isin(*_USER), "user")


def from_tagged(tagged: Column, prefix: bool = True) -> Column:
    """Messages of ``<|user|> ... <|assistant|> ...``; text before the first tag is a user turn or goes."""
    marked = F.regexp_replace(tagged, r"<\|(user|assistant)\|>", "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.split(p, "\u0002", 2))
    both = F.transform(parts, lambda p: F.when(F.size(p) > 1, message(F.get(p, 0), strip(F.get(p, 1)))).otherwise(message(F.lit("user" if prefix else "").cast("string"), strip(F.get(p, 0)))))
    return F.filter(both, lambda m: (m["content"] != "") & (m["role"] != ""))


def from_tagged_lines(tagged: Column) -> Column:
    """Messages of tags at line starts; later lines join their turn, blank ones and what precedes the first tag go."""
    lines = F.filter(F.transform(F.split(tagged, "\n"), strip), lambda x: x != "")

    def step(a: Column, line: Column) -> Column:
        role = F.regexp_extract(line, r"^<\|(user|assistant)\|>", 1)
        rest = strip(F.regexp_replace(line, r"^<\|(user|assistant)\|>", ""))
        last = F.get(a, F.size(a) - 1)
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(message(last["role"], F.when(last["content"] == "", rest).otherwise(F.concat(last["content"], F.lit("\n"), rest)))))
        return F.when(role != "", F.concat(a, F.array(message(role, rest)))).when(F.size(a) > 0, joined).otherwise(a)

    return F.aggregate(lines, F.array().cast(MESSAGE), step)


def stop_reasons(c: Column, phrases: list[str], most: int) -> Column:
    """Why a simulated talk ends: struct(ended, disengaged, at_limit).

    A phrase in the last user turn, one word or none in the last two of them, or ``most`` user turns.
    """
    said = of_role(c, "user")
    last, before = F.try_element_at(said, F.lit(-1))["content"], F.try_element_at(said, F.lit(-2))["content"]
    ended = contains_any(F.lower(last), phrases)
    terse = (n_words(last) <= 1) & (n_words(before) <= 1)
    no = F.lit(False)
    return F.struct(F.coalesce(ended, no).alias("ended"), F.coalesce((F.size(said) > 1) & terse, no).alias("disengaged"), (F.size(said) >= most).alias("at_limit"))


def parity(c: Column, preamble: str, header: str | None = None) -> Column:
    """What keeps a conversation from the format that training expects, null if nothing does.

    The first system turn must hold ``preamble``, and ``header`` too where one is given.
    """
    system = F.get(of_role(c, "system"), 0)["content"]
    why = F.when(system.isNull(), "no system message").when(~F.contains(system, F.lit(preamble)), F.concat(F.lit("missing preamble: "), F.substring(F.replace(system, F.lit("\n"), F.lit("\\n")), 1, 120)))
    return why if header is None else F.when(why.isNotNull(), why).when(~F.contains(system, F.lit(header)), "missing header")
