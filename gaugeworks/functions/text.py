"""Text expressions: prompts, answers, steps, replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns of prompts, answers and replies.
ANSWER_MARKERS = ("<Answer>:", "\n<Answer>:", "\n\nAnswer:", "\nFinal Answer:", "\n\nThe answer is")
STEP_MARKER = "- Step"
QUESTION_ENDS = ("Reasoning Steps:", "Solution:", "Answer:", "\n\n", "- Step")
REFUSALS = ("please provide", "to assist you", "as an ai language model")
NUMBER = r"[-+]?\d*\.?\d+"


def words(text: Column) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def apply_template(template: str, question: Column) -> Column:
    before, _, after = template.partition("{q}")
    return F.concat(F.lit(before), question, F.lit(after))


def invert_template(template: str, prompt: Column) -> Column:
    """What a template's slot holds; the whole prompt where it does not fit the template."""
    before, _, after = template.partition("{q}")
    fits = prompt.startswith(before) & prompt.endswith(after) & (F.length(prompt) >= len(before) + len(after))
    inner = prompt.substr(F.lit(len(before) + 1), F.length(prompt) - len(before) - len(after))
    return F.when(fits & (F.length(inner) > 0), inner).otherwise(prompt)


def letters(choices: Column) -> Column:
    """Lines `  A. choice`."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), F.char((i + 65).cast("long")), F.lit(". "), c)), "\n")


def multiple_choice(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n"), letters(choices))


def facts_answer(yes: Column, facts: Column) -> Column:
    numbered = F.array_join(F.transform(facts, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f)), " ")
    return F.concat(F.when(yes, "Yes").otherwise("No"), F.lit(", according to the facts: "), numbered)


def number(text: Column) -> Column:
    """As a double; null if it is not one."""
    return F.when(text.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(text)).try_cast("double")


def last_number(text: Column) -> Column:
    return number(F.element_at(F.when(text.rlike(r"\d"), F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))), -1))


def final_answer(text: Column) -> Column:
    """A reply's final number: after ####, in \\boxed{}, after <Answer>:, or the last one; null if there is none."""
    after = lambda mark: F.substring_index(text, mark, -1)
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))
    boxed = F.substring_index(plain(F.substring_index(after("\\boxed{"), "}", 1)), "=", -1)
    return (
        F.when(text.contains("####"), number(plain(after("####"))))
        .when(text.contains("\\boxed{"), number(F.regexp_replace(boxed, "%$", "")))
        .when(text.contains("<Answer>:"), last_number(plain(after("<Answer>:"))))
        .otherwise(last_number(plain(text)))
    )


def question_of(trajectory: Column) -> Column:
    """The text before the first kind of ending that leaves any; tags of a chat are cut off."""
    found = F.lit(None).cast("string")
    for end in reversed(QUESTION_ENDS):
        head = F.trim(F.regexp_replace(F.substring_index(trajectory, end, 1), r"^\s+|\s+$", ""))
        found = F.when(trajectory.contains(end) & (F.length(head) > 0), head).otherwise(found)
    found = F.coalesce(found, trajectory)
    inside = F.regexp_extract(found, r"(?s)<\|im_start\|>user(.*?)<\|im_end\|>", 1)
    return F.when(found.contains("<|im_start|>") & (inside != ""), F.trim(inside)).otherwise(found)


def question_tag(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)<Question>:\s*(.*?)<\|im_end\|>", 1)), F.lit(""))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def has_answer(text: Column) -> Column:
    out = F.lit(False)
    for mark in ANSWER_MARKERS:
        out = out | text.contains(mark)
    return out


def step_complete(text: Column, tokens: Column, most_tokens: int) -> Column:
    return has_answer(text) | (count_of(text, STEP_MARKER) >= 2) | (F.coalesce(tokens, F.lit(0)) >= most_tokens)


def _spots_of(text: Column, mark: str) -> Column:
    """Positions of a marker in a text, as structs (p, m)."""
    parts = F.split(text, re.escape(mark))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + len(mark)).cast("int").alias("at"), F.concat(s["all"], F.array((s["at"] + F.length(p)).cast("int"))).alias("all"))
    ends = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["all"]
    return F.transform(ends, lambda p: F.struct(p.alias("p"), F.lit(mark).alias("m")))


def trajectory_complete(text: Column) -> Column:
    """Whether the second marker of steps or answers, by position, is one of an answer. A longer marker counts at its own start."""
    spots = [_spots_of(text, mark) for mark in (STEP_MARKER, *ANSWER_MARKERS)]
    second = F.get(F.sort_array(F.concat(*spots)), F.lit(1))["m"]
    return F.coalesce(second != STEP_MARKER, F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def step_text(text: Column) -> Column:
    """A step without what follows: the next step, then the first kind of answer marker that it holds."""
    text = strip(text)
    cut = F.when(count_of(text, STEP_MARKER) >= 2, strip(F.substring_index(text, STEP_MARKER, 2))).otherwise(text)
    out = cut
    for mark in reversed(ANSWER_MARKERS):
        out = F.when(cut.contains(mark), strip(F.substring_index(cut, mark, 1))).otherwise(out)
    return out


def refusal_to_empty(reply: Column) -> Column:
    return F.when(F.lower(reply).rlike("|".join(REFUSALS)), F.lit("")).otherwise(reply)


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[!-/:-@\[-`{-~]", "")


def grade(reply: Column) -> Column:
    return F.when(reply.contains("<Grade>: Correct"), F.lit(0.0)).when(reply.contains("<Grade>: Incorrect"), F.lit(1.0))


def bullet_claims(reply: Column) -> Column:
    lines = F.filter(F.split(reply, "\n"), lambda x: x.startswith("- ") & ~F.lower(x).contains("there aren't any claims"))
    return F.transform(lines, lambda x: F.trim(x.substr(F.lit(3), F.length(x))))


def label_list(reply: Column) -> Column:
    """A reply like `[1, 0, 1]` as integers; none if all steps are correct; null if it cannot be read."""
    bare = F.replace(F.replace(strip(reply), F.lit(" "), F.lit("")), F.lit("Step"), F.lit(""))
    bare = F.when(bare.contains("```python"), strip(F.substring_index(F.substring_index(bare, "```python", -1), "```", 1))).otherwise(bare)
    bare = F.when(bare.startswith("[") & bare.endswith("]"), bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare)
    items = F.split(bare, ",")
    good = F.forall(items, lambda x: x.rlike(r"^\s*[-+]?\d+\s*$"))
    return F.when(F.lower(reply).contains("all steps are correct"), F.array().cast("array<int>")).when(good, F.transform(items, lambda x: F.trim(x).try_cast("int")))


def json_labels(reply: Column, claims: Column, key: str = "correctness") -> Column:
    """Labels of `claims` claims from a JSON reply: 0 becomes 1 and the rest 0; one label short adds a null; another length gives nulls."""
    read = F.from_json(reply, "correctness array<double>, informativeness array<double>")[key]
    fixed = F.when(F.size(read) + 1 == claims, F.concat(read, F.array(F.lit(None).cast("double")))).when(F.size(read) == claims, read)
    none = F.array_repeat(F.lit(None).cast("double"), claims)
    return F.coalesce(F.transform(fixed, lambda x: F.when(x.isNull(), None).when(x == 0, F.lit(1.0)).otherwise(0.0)), none)


def reason_and_result(reply: Column) -> Column:
    """struct<result, reason> of the last lines [REASON]: and [RESULT]: of a reply; a bare 0 or 1 counts as a result."""
    text = strip(F.coalesce(reply, F.lit("")))
    text = F.when(text.startswith("```") & text.endswith("```"), strip(F.regexp_replace(text, "^`+|`+$", ""))).otherwise(text)
    lines = F.transform(F.split(text, "\n"), strip)
    after = lambda x: strip(F.when(x.contains(":"), x.substr(F.instr(x, ":") + 1, F.length(x))).otherwise(""))
    reasons = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("[reason]")), after)
    marks = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("[result]")), after)
    values = F.filter(F.transform(marks, lambda x: F.when(x.contains("1"), 1.0).when(x.contains("0"), 0.0)), lambda v: v.isNotNull())
    bare = F.replace(F.replace(text, F.lit("`"), F.lit("")), F.lit(" "), F.lit(""))
    return F.struct(F.coalesce(F.try_element_at(values, F.lit(-1)), F.when(bare == "1", 1.0).when(bare == "0", 0.0)).alias("result"), F.coalesce(F.try_element_at(reasons, F.lit(-1)), F.lit("")).alias("reason"))


def binary_reply(reply: Column) -> Column:
    one, zero = reply.contains("1"), reply.contains("0")
    return F.when(one & zero, None).when(one, 1.0).when(zero, 0.0)


def steps_by_marker(text: Column) -> Column:
    """Spans that start at `- Step N:` or `<Answer>:` at a line's start, stripped; what stands before the first one is dropped."""
    parts = F.split(text, r"(?m)^(?=- Step \d+:|<Answer>:)")
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^(- Step \d+:|<Answer>:)")), strip)


def sentences(text: Column) -> Column:
    """Sentences ended by . ? ! or their full-width forms or a line's end; an unfinished last one is dropped."""
    parts = F.split(text, r"(?<=[.?!。？！\n])")
    return F.filter(F.transform(F.filter(parts, lambda p: p.rlike(r"[.?!。？！\n]$")), strip), lambda p: p != "")


def step_normal(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"^- Step \d+: ?", "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the lower-cased words; both sides should be columns."""
    from .arrays import jaccard

    return jaccard(words(F.lower(a)), words(F.lower(b)))


def model_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("validity"), "validity").when(low.contains("redundancy"), "redundancy").when(low.contains("both"), "validity and redundancy").when(low.contains("reward"), "process reward").when(low.contains("head"), "learned head").otherwise("unknown")


# What a fact check answers in English, Chinese and Arabic.
TRUE_WORDS = ("True", "是", "真", "نعم")
FALSE_WORDS = ("False", "否", "假", "لا")


def fact_check(reply: Column) -> Column:
    """0 if a reply calls the claim true, 1 if false, null otherwise; true wins where both occur."""
    some = lambda words: F.lit(False) if not words else reply.contains(words[0]) | some(words[1:])
    return F.when(some(TRUE_WORDS), 0.0).when(some(FALSE_WORDS), 1.0)


def chunks(text: Column, size: int) -> Column:
    """A text's words in pieces of `size`; `text` should be a column."""
    w = words(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda k: k < F.size(w))
    return F.transform(starts, lambda k: F.array_join(F.slice(w, k + 1, F.lit(size)), " "))
