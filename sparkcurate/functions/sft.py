"""Training texts for supervised fine-tuning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.config import SftConfig
from sparkcurate.functions.prompts import placeholders, render


def chat_text(instruction: Column, output: Column) -> Column:
    """One user turn and one assistant turn in chat markup."""
    return F.concat(
        F.lit("<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"),
        output, F.lit("<|im_end|>"),
    )


def multiple_choice_answer(options: list[Column], correct: Column, fallback: Column) -> Column:
    """``B) text`` for a 0-based index that names an option, else the given response."""
    letters = F.array(*[F.lit(chr(ord("A") + i)) for i in range(len(options))])
    place = (correct + 1).cast("int")
    named = F.concat(
        F.element_at(letters, place), F.lit(") "),
        F.coalesce(F.element_at(F.array(*options), place), F.lit("")),
    )
    return F.when(correct.between(0, len(options) - 1), named).otherwise(fallback)


def training_text(config: SftConfig, columns: list[str]) -> Column:
    """The prompt template filled from one row; ``columns`` are the columns the data has.

    Multiple choice fills instruction, four options, context, answer; context data fills
    instruction, context, response; plain data fills instruction, response.
    """

    def col(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    instruction = col(config.instruction)
    response = col(config.response) if config.response in columns else F.lit("")
    context = F.lit("")
    if config.context_format and config.context_fields:
        known = {f: col(f) for f in config.context_fields if f in columns}
        if placeholders(config.context_format) <= known.keys():
            context = render(config.context_format, **known)

    if config.options and config.correct_option:
        options = [col(o) for o in config.options]
        answer = multiple_choice_answer(options, col(config.correct_option), response)
        shown = (options + [F.lit("")] * 4)[:4]
        return render(config.prompt_template, instruction, *shown, context, answer)
    if config.context_fields and config.context_format:
        return render(config.prompt_template, instruction, context, response)
    return render(config.prompt_template, instruction, response)
