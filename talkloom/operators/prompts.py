"""System prompts: rendering from a seed, reading back, and repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom.functions.text import strip

#: Markers of prompt blocks (fixed values).
USER, RECENT, HEALTH = "[User]", "[Recent sessions]", "[Health data — last 7 days]"
DATED = r"^\[[A-Z][a-z]{2} \d{1,2}\]"


def render(base: str, header: str, profile: Column, memory: Column, health: Column | None = None) -> Column:
    """The base alone without anything to remember; else base, header and the blocks that are not empty."""
    health = F.lit(None).cast("string") if health is None else health
    part = lambda mark, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(mark + "\n"), x))
    blocks = F.concat_ws("\n\n", part(USER, profile), part(RECENT, memory), part(HEALTH, health))
    return F.when(blocks == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}\n\n{header}\n"), blocks))


def seed_of(base: str, header: str, prompt: Column) -> Column:
    """Struct(profile, memory, health) that ``render`` made the prompt from; nulls for absent blocks.

    The inverse of ``render`` for seeds whose parts hold no blank line followed by a marker.
    """
    body = F.when(prompt.startswith(f"{base}\n\n{header}\n"), F.substring(prompt, F.lit(len(base) + len(header) + 4), F.length(prompt)))
    parts = F.split(F.concat(F.lit("\n\n"), F.coalesce(body, F.lit(""))), r"\n\n(?=\[User\]\n|\[Recent sessions\]\n|\[Health data — last 7 days\]\n)")

    def block(mark: str) -> Column:
        own = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(mark + "\n"))), 0)
        return F.substring(own, F.lit(len(mark) + 2), F.length(own))

    return F.struct(block(USER).alias("profile"), block(RECENT).alias("memory"), block(HEALTH).alias("health"))


def _suffix(text: Column, mark: str, whole_line: bool) -> Column:
    """``text`` from the first ``mark`` on, which must be a line of its own if ``whole_line``; empty without one."""
    literal = mark.replace("[", r"\[").replace("]", r"\]")
    shape = rf"(?s)\A(?:.*?\n)?({literal}(?:\n.*)?)\z" if whole_line else rf"(?s)\A.*?({literal}.*)\z"
    return F.regexp_extract(text, shape, 1)


def _parts(text: Column, whole_line: bool) -> tuple[Column, Column]:
    """Profile and memory behind their markers, null without one.  Of two suffixes the shorter starts later, so a
    profile ends where a shorter memory begins."""
    user, recent = _suffix(text, USER, whole_line), _suffix(text, RECENT, whole_line)
    inside = F.when(F.length(recent) < F.length(user), F.length(user) - F.length(recent)).otherwise(F.length(user))
    behind = lambda x, mark, end: F.when(x != "", strip(F.substring(x, F.lit(len(mark) + 1), F.greatest(end - len(mark), F.lit(0)))))
    return behind(user, USER, inside), behind(recent, RECENT, F.length(recent))


def normalise(base: str, header: str, prompt: Column) -> Column:
    """Canonical form of a prompt whose markers are whole lines; null if it has neither.

    The first of each marker counts.  Applying it again changes nothing.
    """
    profile, memory = _parts(prompt, True)
    return F.when(F.coalesce(profile, memory).isNotNull(), render(base, header, profile, memory))


def salvage(base: str, header: str, prompt: Column) -> Column:
    """The same for prompts that lost base and header: markers anywhere, what stands before a lone memory is the
    profile, and text that opens with a date is memory."""
    s = strip(prompt)
    profile, memory = _parts(s, False)
    lead = strip(F.substring(s, F.lit(1), F.length(s) - F.length(_suffix(s, RECENT, False))))
    marked = F.when(F.coalesce(profile, memory).isNotNull(), render(base, header, F.coalesce(profile, lead), memory))
    return F.coalesce(marked, F.when(s.rlike(DATED), render(base, header, F.lit(""), s)))


def route(base: str, header: str, prompt: Column, fix_stripped: bool = True) -> Column:
    """Struct(kind, prompt): canonical prompts rebuilt, stripped ones salvaged, the rest skipped."""
    canonical = prompt.startswith(base)
    new = F.when(canonical, normalise(base, header, prompt)).when(F.lit(fix_stripped), salvage(base, header, prompt))
    kind = F.when(new.isNull(), "skipped").when(new == prompt, "unchanged").when(canonical, "rebuilt").otherwise("salvaged")
    return F.struct(kind.alias("kind"), F.coalesce(new, prompt).alias("prompt"))


def variant(base: str, prompt: Column, mode: str) -> Column:
    """The prompt whole (full), its base (preamble), or none of it."""
    return {"full": prompt, "none": F.lit("")}.get(mode, F.lit(base))


#: Phrases that make a criterion one of absence; {name} is the assistant's own name (fixed values).
NEGATIVE = (
    "ai avoid", "model avoid", "{name} avoid",
    "ai does not", "model does not", "{name} does not",
    "ai doesn't", "model doesn't", "{name} doesn't",
    "ai never", "model never", "{name} never",
    "ai refrain", "model refrain", "{name} refrain",
    "ai not", "model not say", "{name} not",
)


def is_negative(question: Column, name: str = "assistant") -> Column:
    """Whether a criterion asks for the absence of something the model, called ``name``, might do."""
    return F.exists(F.array(*[F.lit(p.format(name=name.lower())) for p in NEGATIVE]), lambda p: F.contains(F.lower(question), p))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Literal placeholders replaced one after another."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def judge_prompt(question: Column, transcript: Column, strict: bool = False) -> Column:
    tail = "Think step by step, then write YES or NO on the last line." if strict else "Answer YES or NO only."
    return fill("Conversation:\n{t}\n\nQuestion: {q}\n" + tail, {"q": question, "t": transcript})
