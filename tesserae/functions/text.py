"""Captions, targets, prompts and variant fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .perm import format_rank, identity, invert

# ---- captions -----------------------------------------------------------------------------

#: The connectives that split a caption where telling order is time order.
SEQUENTIAL = r",?\s*(?:and\s+)?\bthen\b,?\s*|,?\s+followed\s+by\s+|,?\s*(?:and\s+)?\bfinally\b,?\s*|,?\s*(?:and\s+)?\bnext\b,\s*|,?\s+ending\s+with\s+|,?\s*(?:and\s+)?\bafterwards?\b,?\s+|,?\s*\bsubsequently\b,?\s*|;\s*|,?\s+before\s+"
MID_AFTER = r",?\s+after\s+"
LEADING = r"^\s*%s\s+(.+?),\s*(.+)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_clause(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^[ ,.;]+|[ ,.;]+$", ""))


def split_events(caption: Column) -> Column:
    """Clauses of a caption in order of time; null or blank gives an empty array."""
    s = F.coalesce(caption, F.lit(""))
    after, before = "(?isU)" + LEADING % "after", "(?isU)" + LEADING % "before"
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    segments = F.when(s.rlike(after), F.array(part(after, 1), part(after, 2))).when(s.rlike(before), F.array(part(before, 2), part(before, 1))).otherwise(F.array(s))
    chunks = F.flatten(F.transform(segments, lambda x: F.split(x, "(?iU)" + SEQUENTIAL, -1)))
    clauses = F.flatten(F.transform(chunks, lambda x: F.reverse(F.split(x, "(?iU)" + MID_AFTER, -1))))
    return F.filter(F.transform(clauses, clean_clause), lambda x: x != "")


def _finish(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def _templates(ev: Column) -> list[Column]:
    at = lambda i: F.get(ev, F.lit(i))
    last = F.try_element_at(ev, F.lit(-1))
    init = F.array_join(F.slice(ev, F.lit(1), F.greatest(F.size(ev) - 1, F.lit(0))), ", then ")
    rest = F.slice(ev, F.lit(3), F.greatest(F.size(ev) - 2, F.lit(0)))
    more = F.when(F.size(ev) > 2, F.concat(F.lit(", then "), F.array_join(rest, ", then "))).otherwise("")
    return [_finish(c) for c in (
        F.array_join(ev, ", then "),
        F.array_join(ev, ", followed by "),
        F.concat(init, F.lit(", finally "), last),
        F.concat(at(0), F.lit(" before "), at(1), more),
        F.concat(at(1), F.lit(" after "), at(0), more),
        F.concat(init, F.lit(", ending with "), last),
    )]


def caption_variants(caption: Column, events: Column) -> Column:
    """Connective rewrites that split into the same events again; in template order, without repeats."""
    good = F.filter(F.array(*_templates(events)), lambda v: (v != strip(caption)) & (split_events(v) == events))
    return F.when(F.size(events) >= 2, F.array_distinct(good)).otherwise(F.array().cast("array<string>"))


def pick(options: Column, fallback: Column, draw: Column) -> Column:
    return F.when(F.size(options) > 0, F.get(options, F.pmod(draw, F.size(options)).cast("int"))).otherwise(fallback)


def merge_variants(caption: Column, *sources: Column) -> Column:
    """Ordered union of variant arrays, stripped, without blanks, repeats or the caption itself."""
    return F.array_distinct(F.filter(F.transform(F.concat(*sources), strip), lambda v: (v != "") & (v != strip(caption))))


# ---- targets and prompts --------------------------------------------------------------------

#: Texts that training and parsing agree on.
ORDINALS = ["1st", "2nd", "3rd", "4th"]
REASON = "The four frames cannot be uniquely aligned to the caption's timeline: the caption does not determine the relative order of some frames (e.g., multiple frames depict the same described event)."
SPEC = {
    "cot": "Respond in exactly this format:\nStep 1 - Events described in the caption, in temporal order:\n  E1. <event>\n  ...\nStep 2 - Matching frames to the timeline (or why the frames cannot be uniquely ordered):\n  1st in time: Frame <n>\n  ...\nStep 3 - Temporal position of each frame: Frame 1 -> <ordinal>, ...\nConclusion: ORDERABLE or UNORDERABLE\nAnswer: [r1, r2, r3, r4]",
    "mid": "Respond in exactly this format (omit the Order line if UNORDERABLE):\nOrder: Frame a -> Frame b -> Frame c -> Frame d\nConclusion: ORDERABLE or UNORDERABLE\nAnswer: [r1, r2, r3, r4]",
    "short": "Respond in exactly this format:\nConclusion: ORDERABLE or UNORDERABLE\nAnswer: [r1, r2, r3, r4]",
}
TASK = ("The four images above are frames from a single video, shown in SHUFFLED order and labeled Frame 1, Frame 2, Frame 3, Frame 4.\nCaption describing the video in temporal order: \"", "\"\nTask: use the caption and visual cues to recover the chronological order of the frames. r_i in the Answer is the temporal position (1-4) of Frame i.\nIf the frames cannot be uniquely ordered from the caption (e.g., several frames depict the same described event), conclude UNORDERABLE and answer [1, 2, 3, 4].\n")
REWRITE_SYSTEM = "You create concise, safe English caption paraphrases for vision-language training. Return only JSON."
REWRITE = ("Original caption:\n", "\n\nTemporal events that must stay in the same order:\n", "\n\nWrite ", " paraphrases as one-sentence captions. Preserve all concrete people, objects, actions, and the chronological order. Do not add visual details, frame numbers, answers, labels, or explanations. Return exactly {\"variants\": [\"...\", \"...\"]}.")
STYLES = tuple(SPEC)


def _style(style: str) -> str:
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}, not {style}")
    return style


def _ordinal(r: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in ORDINALS]), (r - 1).cast("int"))


def build_target(style: str, events: Column, rank: Column, no_ordering: Column) -> Column:
    """The text a model is taught to answer with."""
    _style(style)
    order, answer = invert(rank), F.concat(F.lit("Answer: "), format_rank(rank))
    refuse = F.concat(F.lit("Conclusion: UNORDERABLE\nAnswer: "), format_rank(identity()))
    if style == "short":
        return F.when(no_ordering, refuse).otherwise(F.concat_ws("\n", F.lit("Conclusion: ORDERABLE"), answer))
    if style == "mid":
        line = F.concat(F.lit("Order: "), F.array_join(F.transform(order, lambda k: F.concat(F.lit("Frame "), k.cast("string"))), " -> "))
        return F.when(no_ordering, refuse).otherwise(F.concat_ws("\n", line, F.lit("Conclusion: ORDERABLE"), answer))
    listed = F.transform(events, lambda e, i: F.concat(F.lit("  E"), (i + 1).cast("string"), F.lit(". "), e))
    head = F.concat(F.array(F.lit("Step 1 - Events described in the caption, in temporal order:")), listed)
    note = lambda k: F.when(F.size(events) == 4, F.concat(F.lit(" (E"), k.cast("string"), F.lit(")"))).otherwise("")
    times = F.transform(order, lambda f, i: F.concat(F.lit("  "), _ordinal(i + 1), F.lit(" in time: Frame "), f.cast("string"), note(i + 1)))
    places = F.array_join(F.transform(rank, lambda r, i: F.concat(F.lit("Frame "), (i + 1).cast("string"), F.lit(" -> "), _ordinal(r))), ", ")
    full = F.concat(head, F.array(F.lit("Step 2 - Matching frames to the timeline:")), times, F.array(F.concat(F.lit("Step 3 - Temporal position of each frame: "), places), F.lit("Conclusion: ORDERABLE"), answer))
    none = F.concat(head, F.array(F.lit("Step 2 - " + REASON), refuse))
    return F.array_join(F.when(no_ordering, none).otherwise(full), "\n")


def build_instruction(style: str, caption: Column) -> Column:
    return F.concat(F.lit(TASK[0]), caption, F.lit(TASK[1] + SPEC[_style(style)]))


def build_messages(images: Column, caption: Column, style: str, target: Column | None = None) -> Column:
    """Chat turns as array<struct<role, images, text>>: the images and instruction, then the target if there is one."""
    turn = lambda role, im, text: F.struct(F.lit(role).alias("role"), im.alias("images"), text.alias("text"))
    ask = turn("user", images, build_instruction(style, caption))
    return F.array(ask) if target is None else F.array(ask, turn("assistant", F.array().cast("array<string>"), target))


def rewrite_prompt(caption: Column, events: Column, n: Column) -> Column:
    listed = F.array_join(F.transform(events, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e)), "\n")
    return F.concat(F.lit(REWRITE[0]), caption, F.lit(REWRITE[1]), listed, F.lit(REWRITE[2]), n.cast("string"), F.lit(REWRITE[3]))


# ---- variant fields -------------------------------------------------------------------------

#: Fixed values.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her", "his", "in", "into", "is", "it", "its", "of", "on", "or", "she", "the", "their", "then", "they", "to", "with"]
LEAK = r"(?iU)\b(frame|answer|conclusion|orderable|unorderable)\b"


def content_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def is_valid_variant(candidate: Column, original: Column, events: Column | None = None, overlap: float = 0.45, count_events: bool = False) -> Column:
    text, own = strip(F.coalesce(candidate, F.lit(""))), content_tokens(original)
    short = F.length(text) <= F.greatest(F.lit(240), F.floor(F.length(original) * 1.8).cast("int"))
    shared = (F.size(own) == 0) | (F.size(F.array_intersect(own, content_tokens(text))) / F.greatest(F.size(own), F.lit(1)) >= overlap)
    ok = (text != "") & (F.lower(text) != F.lower(strip(original))) & short & ~text.rlike(LEAK) & shared
    return ok & (F.size(split_events(text)) == F.size(events)) if count_events else ok


def _strings(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: strip(x)), lambda x: x != "")


def _json_list(c: Column) -> Column:
    return F.when(strip(c).startswith("["), F.from_json(c, "array<string>"))


def parse_variants(text: Column) -> Column:
    """Variants of a reply: the whole text, or else its outermost braces, as an object with ``variants`` or as a list."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    read = lambda c: F.when(strip(c).startswith("{"), F.from_json(c, "struct<variants array<string>>")["variants"]).otherwise(_json_list(c))
    return F.coalesce(_strings(F.coalesce(read(text), read(inner))), F.array().cast("array<string>"))


def normalise_variants(text: Column, scalar_as_text: bool = True) -> Column:
    """A variant field given as text: a JSON list, or parts between ``|||``; other JSON is the text itself, or nothing."""
    t = strip(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    is_json = t.rlike(r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|\".*\"|\{.*\})$") & F.expr("true")
    whole = F.array(t) if scalar_as_text else none
    return F.when(t == "", none).when(_json_list(t).isNotNull(), _strings(_json_list(t))).when(is_json, whole).otherwise(_strings(F.split(t, r"\|\|\|", -1)))


def truthy(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin("1", "true", "t", "yes", "y")


def clamp01(c: Column, lenient: bool = False) -> Column:
    """To [0, 1]; strict casts raise on text that is no number and keep null, lenient ones give 0."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0)) if lenient else c.cast("double")
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def hard_score(score: Column, em: Column, correct: Column) -> Column:
    """hard_score if given, else 0 or 1 by em, else by correct, else 0; blanks count as missing."""
    given = lambda c: F.when(c.cast("string") != "", c)
    flag = lambda c: F.when(given(c).isNotNull(), F.when(truthy(c), 0.0).otherwise(1.0))
    return F.coalesce(clamp01(given(score)), flag(em), flag(correct), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / 4))


def cost_usd(tokens_in: Column, tokens_out: Column, usd_in: float = 0.10, usd_out: float = 0.625) -> Column:
    return (tokens_in * usd_in + tokens_out * usd_out) / 1_000_000.0


def word_count(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "/+$", "") for p in parts])
