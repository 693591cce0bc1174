"""JSON documents and prompts in columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@F.udtf(returnType="label string, value double")
class NumericLeaves:
    """The numbers of a JSON document by dotted label; keys that begin with _ and what is below them are
    left out, as are true and false. Text that is no JSON has none."""

    def eval(self, text: str):
        try:
            left = [("", json.loads(text))] if text is not None else []
        except ValueError:
            return
        while left:
            path, node = left.pop()
            if isinstance(node, dict):
                left += [(f"{path}.{k}" if path else k, v) for k, v in node.items() if not k.startswith("_")]
            elif isinstance(node, list):
                left += [(f"{path}.{i}" if path else str(i), v) for i, v in enumerate(node)]
            elif isinstance(node, (int, float)) and not isinstance(node, bool):
                yield path, float(node)


def flattened(df: DataFrame, text: str) -> DataFrame:
    """df without its column of JSON documents, a row for each of their numbers with label and value."""
    rest = [F.col(c) for c in df.columns if c != text]
    return df.lateralJoin(NumericLeaves(F.col(text).outer())).select(*rest, "label", "value")


#: A line that opens a section, and the start of one that closes the last.
HEAD, CLOSING = r"^([A-Z]+): (.*)$", "Constraint:"
_SECTION = "struct<name:string,text:string>"
_STATE = f"struct<before:array<string>,now:string,sections:array<{_SECTION}>>"


def parsed_prompt(text: Column) -> Column:
    """(instruction, sections) of a prompt: a line `NAME: text` opens a section, lines that follow continue
    it, a line that begins with `Constraint:` closes it and goes; lines in no section are the instruction.
    A section that is opened again starts anew in its old place. Null for null."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.split(strip(text), "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("before"), F.lit(None).cast("string").alias("now"), F.array().cast(f"array<{_SECTION}>").alias("sections")).cast(_STATE)

    def state(before: Column, now: Column, sections: Column) -> Column:
        return F.struct(before.alias("before"), now.alias("now"), sections.alias("sections")).cast(_STATE)

    def step(acc: Column, line: Column) -> Column:
        name, said = F.regexp_extract(line, HEAD, 1), F.regexp_extract(line, HEAD, 2)
        section = lambda n, t: F.struct(n.alias("name"), t.alias("text")).cast(_SECTION)
        change = lambda key, of: F.transform(acc["sections"], lambda s: F.when(s["name"] == key, section(s["name"], of(s))).otherwise(s))
        known = F.exists(acc["sections"], lambda s: s["name"] == name)
        opened = F.when(known, change(name, lambda s: said)).otherwise(F.concat(acc["sections"], F.array(section(name, said))))
        return (
            F.when(name != "", state(acc["before"], name, opened))
            .when(F.startswith(line, F.lit(CLOSING)), state(acc["before"], F.lit(None).cast("string"), acc["sections"]))
            .when(acc["now"].isNotNull(), state(acc["before"], acc["now"], change(acc["now"], lambda s: F.concat(s["text"], F.lit(" "), strip(line)))))
            .otherwise(state(F.concat(acc["before"], F.array(line)), acc["now"], acc["sections"])))

    done = lambda acc: F.struct(strip(F.array_join(acc["before"], " ")).alias("instruction"), F.map_from_entries(acc["sections"]).alias("sections"))
    return F.when(text.isNotNull(), F.aggregate(lines, start, step, done))


def inverted(m: Column) -> Column:
    """A map's keys by its values; of keys with one value the last stands, null values are left out."""
    entries = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    values = F.array_distinct(F.transform(entries, lambda e: e["value"]))
    return F.map_from_arrays(values, F.transform(values, lambda v: F.element_at(F.filter(entries, lambda e: e["value"] == v), -1)["key"]))
