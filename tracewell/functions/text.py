"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no identity of an answer, and those of a mention.
FILLER = r"\b(the|a|an|likely|most|diagnosis|of|is|with|due|to)\b"
STOPWORDS = (
    "l", "r", "left", "right", "bilateral", "unilateral", "sided", "side",
    "upper", "lower", "proximal", "distal", "anterior", "posterior",
    "syndrome", "disease", "disorder", "condition", "infection", "reaction",
    "deficiency", "insufficiency", "failure", "injury", "lesion", "tumour", "tumor",
    "carcinoma", "cancer", "malignancy", "neoplasm", "abnormality",
    "acute", "chronic", "severe", "mild", "moderate", "primary", "secondary",
    "early", "late", "recurrent", "congenital", "acquired", "idiopathic",
    "the", "a", "an", "of", "and", "or", "with", "due", "to", "in", "on", "for",
    "type", "stage", "grade", "class", "possible", "probable", "likely", "suspected",
)
#: Fixed values of the answer template.
PLACEHOLDER = "...the name of the disease/entity..."
SLOT = r"(?iu)\.\.\.\s*(?:the name of the disease/entity|your internal reasoning for the diagnosis)\s*\.\.\."
FORMAT_TALK = r"(?iu)\b(?:answers?|tags?|template|output requirement|internal reasoning|disease/entity)\b"
TEMPLATE_THOUGHTS = ("...", "...your internal reasoning for the diagnosis...")
LONGEST_ANSWER = 160
MOST_BOLD = 3


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def squeezed(text: Column) -> Column:
    """Stripped, runs of white space as one space."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*\z")


def normalised_answer(text: Column) -> Column:
    """Lower case without marks and filler words, so that small rewordings agree."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s]", " ")
    return squeezed(F.regexp_replace(plain, FILLER, " "))


def loosely_normalised(text: Column) -> Column:
    """Lower case, marks as spaces, spaces squeezed: answers that agree here are one."""
    return squeezed(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def letters_id(text: Column) -> Column:
    """Identity of a case: MD5 of its ASCII letters alone."""
    return F.md5(F.regexp_replace(text, "[^a-zA-Z]", "").cast("binary"))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lowered."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def content_words(name: Column) -> Column:
    """Distinct tokens without stop words, in order."""
    return F.array_distinct(F.filter(tokens(name), lambda t: ~t.isin(*STOPWORDS)))


def flat(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def names(flattened: Column, words: Column) -> Column:
    """Whether a flattened sentence holds every word, inside longer ones as well; no words are never named."""
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(flattened, w))


def undressed(span: Column) -> Column:
    """The answer in a span without template slots, emphasis and tags; empty if it is none.

    None is what has no letter or digit, more than LONGEST_ANSWER characters, or
    words about the output format.
    """
    bare = F.regexp_replace(F.replace(F.regexp_replace(span, SLOT, ""), F.lit(PLACEHOLDER), F.lit("")), r"\*\*|`", "")
    found = squeezed(F.regexp_replace(bare, r"(?U)</?[^<>\s]*>?", " "))
    found = stripped(F.regexp_replace(found, r"(?U)\A\s*(?:\.{2,}|…)\s*|\s*(?:\.{2,}|…)\s*\z", ""))
    fine = found.rlike("[A-Za-z0-9]") & (F.length(found) <= LONGEST_ANSWER) & ~found.rlike(FORMAT_TALK)
    return F.when(fine, found).otherwise("")


def tagged(response: Column) -> Column:
    """The last answer block that holds an answer, as it stands there without the placeholder."""
    blocks = F.regexp_extract_all(response, F.lit(r"(?siU)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
    clean = F.transform(blocks, lambda b: stripped(F.replace(stripped(b), F.lit(PLACEHOLDER), F.lit(""))))
    good = F.filter(clean, lambda b: (b != "") & (undressed(b) != ""))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))


def sandwiched(response: Column) -> Column:
    """What stands between two closing tags, at the last such place."""
    found = F.regexp_extract_all(response, F.lit(r"(?siU)</answer>\s*(.*?)\s*</answer>"), F.lit(1))
    return F.coalesce(stripped(F.try_element_at(found, F.lit(-1))), F.lit(""))


def after_think(response: Column) -> Column:
    return F.when(F.contains(response, F.lit("</think>")), stripped(F.substring_index(response, "</think>", -1))).otherwise("")


def prose_after_think(response: Column) -> Column:
    """First sentence after the last closing think tag; all of it if none ends."""
    after = after_think(response)
    first = F.regexp_extract(after, r"(?sU)^(.+?[.!?])(?:\s|\z)", 1)
    return F.when(first != "", stripped(first)).otherwise(after)


def bold_after_think(response: Column) -> Column:
    """First bold span after the last closing think tag, where there are few and it is short."""
    after = F.when(F.contains(response, F.lit("</think>")), F.substring_index(response, "</think>", -1)).otherwise("")
    bold = F.regexp_extract_all(after, F.lit(r"(?s)\*\*(.+?)\*\*"), F.lit(1))
    first = stripped(F.try_element_at(bold, F.lit(1)))
    return F.when((F.size(bold) <= MOST_BOLD) & (F.length(first) <= LONGEST_ANSWER), first).otherwise("")


def think_blocks(response: Column) -> Column:
    """Contents of think blocks without the template's own."""
    found = F.regexp_extract_all(response, F.lit("(?si)<think>(.*?)</think>"), F.lit(1))
    return F.filter(F.transform(found, stripped), lambda b: ~b.isin(*TEMPLATE_THOUGHTS))


def longest(blocks: Column) -> Column:
    """The longest entry, the first of equal ones; null for none."""
    return F.aggregate(blocks, F.lit(None).cast("string"), lambda best, b: F.when(best.isNull() | (F.length(b) > F.length(best)), b).otherwise(best))


def prompt_case(question: Column) -> Column:
    """Text of the case between the rulers of a rendered prompt."""
    rule = "-" * 40
    return stripped(F.regexp_extract(question, f"(?s){rule}\nCASE PRESENTATION\n{rule}\n(.*?)\n{rule}\nOUTPUT TEMPLATE\n{rule}", 1))


def rendered(template: str, case: Column) -> Column:
    """A prompt template with its case."""
    return F.replace(F.lit(template), F.lit("{case_prompt}"), case)


def prefix_digest(ids: Column) -> Column:
    """SHA-256 of comma-joined token ids."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)


def sample_seed(base: int, trace_id: Column, boundary: Column, first: Column) -> Column:
    """Seed of a batch of samples, from the trace's leading hex digits, the boundary and the first sample's number."""
    head = F.conv(F.substring(trace_id, 1, 8), 16, 10).cast("long")
    return (F.lit(base) + head + 1_000_003 * boundary + first) % ((1 << 31) - 1)


def embedding_key(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)
