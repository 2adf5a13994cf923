"""Captions: assembly, affixes, hints and prompts as expressions over one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.config import ExportProfile
from loomset.functions.text import affix_stem, by_key, flatten, none_if_empty, utrim
from loomset.operators.tags import positives

#: Fixed value: how hints are introduced to a captioner.
CONTEXT = "Use the following names and details when describing the image:\n"


def export_caption(manual_caption: Column, captions: Column) -> Column:
    """The manual caption as it is, or the flattened others in order of key; none: null."""
    lines = F.filter(F.transform(F.filter(by_key(captions), lambda e: ~F.coalesce(e.value.skip, F.lit(False))), lambda e: flatten(e.value.caption)), lambda x: x != "")
    return F.coalesce(none_if_empty(utrim(manual_caption)), none_if_empty(F.array_join(lines, "\n")))


def matched_affixes(rules: dict[str, str], present: Column) -> Column:
    """Affixes of the rules whose tag is present, in order of tag."""
    out = F.lit("")
    for tag in sorted(rules):
        bare = affix_stem(F.lit(tag))
        out = F.concat(out, F.when(F.array_contains(present, bare) & (bare != ""), F.lit(rules[tag])).otherwise(F.lit("")))
    return out


def build_caption(profile: ExportProfile, manual: Column, manual_caption: Column, captions: Column) -> Column:
    body = export_caption(manual_caption, captions)
    if not profile.caption_prefixes and not profile.caption_suffixes:
        return body
    present = F.transform(positives(manual), affix_stem)
    return F.concat(matched_affixes(profile.caption_prefixes, present), body, matched_affixes(profile.caption_suffixes, present))


def hint_prompt(hints: Column) -> Column:
    """Hints as a list, a line each; none: null."""
    kept = F.filter(F.transform(hints, lambda h: utrim(h)), lambda h: h != "")
    return none_if_empty(F.array_join(F.transform(kept, lambda h: F.concat(F.lit("- "), h)), "\n"))


def user_text(prompt: Column, context: Column) -> Column:
    c = none_if_empty(utrim(context))
    return F.when(c.isNull(), prompt).otherwise(F.concat(F.lit(CONTEXT), c, F.lit("\n\n"), prompt))
