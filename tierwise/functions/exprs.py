"""Column functions: hashes, text normalisation, probabilities, prices. All stay inside code generation or built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text functions of the data's origin know it: Unicode white space and the separators 1c to 1f.
SPACE = r"[\s\x1c-\x1f]"
TWO_64 = 18446744073709551616.0
BINS = 15


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


#: The letters whose folded form is the capital one (Cherokee), small and capital in the same order.
_SMALL_CHEROKEE = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_LARGE_CHEROKEE = "".join(map(chr, range(0x13A0, 0x13F6)))


def casefold(text: Column) -> Column:
    """Full case folding: ligatures, sharp s, final sigma and Greek letters with an iota below as their folded sequences.

    Capital letters made small again are the folded form, but for the capital sharp s, which has no other capital, the dotless i, which
    stays as it is, and Cherokee, which is folded to capitals. The capital sigma is made small by itself, as its
    small form depends on its place in a word; without a step between them the optimizer would also leave out the capitals.
    """
    fold = lambda x: F.lower(F.replace(F.upper(F.replace(x, F.lit("\u1e9e"), F.lit("ss"))), F.lit("Σ"), F.lit("σ")))
    kept = F.when(F.instr(text, "ı") > 0, F.array_join(F.transform(F.split(text, "ı"), fold), "ı")).otherwise(fold(text))
    return F.translate(kept, _SMALL_CHEROKEE, _LARGE_CHEROKEE)


def normalize(text: Column) -> Column:
    """One space for each run of white space, stripped, case-folded."""
    return casefold(F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))


def query_id(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def cache_key(prompt: Column, model: Column) -> Column:
    """Hash of prompt, a NUL character and model."""
    return F.sha2(F.concat(prompt, F.char(F.lit(0)), model), 256)


def hash_unit(*parts: Column) -> Column:
    """A number from 0 to 1 from the first 64 bits of the hash of the parts, joined by colons."""
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(TWO_64)


def seed_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cost_tokens(text: Column) -> Column:
    """Tokens of a chat prompt: a quarter of its characters and 8 for the frame."""
    return seed_tokens(text) + 8


def round_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def percent_text(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("-")).otherwise(F.concat(F.format_number(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1), F.lit("%")))


def choice_prompt(question: Column, choices: Column) -> Column:
    """A question with its choices, one a line, lettered A to D; further choices are left out."""
    letters = F.array(*map(F.lit, "ABCD"))
    n = F.least(F.size(choices), F.lit(4))
    lines = F.zip_with(F.slice(letters, 1, n), F.slice(choices, 1, n), lambda a, c: F.concat(a, F.lit(". "), c))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def base_model(model: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(model, "/"), -1)))


def error_class(error: Column) -> Column:
    return F.split_part(error, F.lit(":"), F.lit(1))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of logits, in double precision and shifted by the largest."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    z = F.transform(logits, lambda v: v.cast("double") / t)
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_sum_exp(values: Sequence[Column]) -> Column:
    top = F.greatest(*values)
    total = sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top))
    return top + F.log(total)


def argmax(values: Column) -> Column:
    """Place of the largest, from 0; the first of ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("double"))


def bin_edges(n: int = BINS) -> list[float]:
    """n + 1 equal-width edges from 0 to 1."""
    return [i * (1.0 / n) for i in range(n)] + [1.0]


def price(usd_in: Column, usd_out: Column, local: Column) -> Column:
    """USD a token as a struct: the configured pair a million tokens, 0 for a local model, else null. Half a pair is an error."""
    partial = usd_in.isNull() != usd_out.isNull()
    pair = F.struct((usd_in / 1e6).alias("prompt"), (usd_out / 1e6).alias("completion"))
    free = F.struct(F.lit(0.0).alias("prompt"), F.lit(0.0).alias("completion"))
    return F.when(partial, F.raise_error(F.lit("only one of the two prices is set"))).when(usd_in.isNotNull(), pair).when(local, free)


def token_cost(prompt_tokens: Column, completion_tokens: Column, a: Column, b: Column) -> Column:
    return prompt_tokens * a + completion_tokens * b


def truncate_words(text: Column, n: int = 128) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def backoff(attempt: Column, unit: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before a retry: doubled each time up to a limit, times a jitter of 0.5 to 1 from a number of 0 to 1."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt)) * (F.lit(0.5) + unit / 2)
