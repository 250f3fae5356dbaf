"""String and label functions as JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from . import codes


def literal_map(mapping: Mapping) -> Column:
    """A fixed Python mapping as a map literal."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def strip_stress(symbol: Column) -> Column:
    """Delete the digits of a phoneme symbol (``AH0`` -> ``AH``)."""
    return F.regexp_replace(symbol, r"\d", "")


def map_symbol(symbol: Column, mapping: Mapping[str, str] = codes.INGEST_SYMBOLS) -> Column:
    """Stress-free symbol replaced through ``mapping``; unknown symbols stay."""
    plain = strip_stress(symbol)
    return F.coalesce(F.try_element_at(literal_map(mapping), plain), plain)


def phoneme_value(symbol: Column, task: Column) -> Column:
    """Label stored with a phoneme event: the symbol map applies unless the task is lexical."""
    return F.when(task == "lexical", strip_stress(symbol)).otherwise(map_symbol(symbol))


def target_code(symbol: Column) -> Column:
    """Common label code of a symbol; an unknown symbol is an error."""
    mapped = F.coalesce(F.try_element_at(literal_map(codes.DECODE_SYMBOLS), symbol), symbol)
    code = F.try_element_at(literal_map(codes.TARGET_CODES), mapped)
    return F.coalesce(
        code, F.raise_error(F.concat(F.lit("no label code for symbol "), mapped)).cast("int")
    )


def articulator(code: Column) -> Column:
    """Articulator class of a label code; an unknown code is an error."""
    found = F.try_element_at(literal_map(codes.ARTICULATORS), code)
    return F.coalesce(
        found,
        F.raise_error(F.concat(F.lit("no articulator for code "), code.cast("string"))).cast("int"),
    )


def articulator_sequence(seq: Column) -> Column:
    return F.transform(seq, articulator)


def label_string(seq: Column) -> Column:
    """Label sequence ``[1, 2, 3]`` -> ``'123'``."""
    return F.array_join(F.transform(seq, lambda x: x.cast("string")), "")


def split_annotation(text: Column) -> tuple[Column, Column]:
    """``'stimulus/word/x'`` -> (trial_type ``'stimulus'``, value ``'word/x'``)."""
    parts = F.split(text, "/", 2)
    return parts.getItem(0), F.get(parts, F.lit(1))


def last_component(text: Column) -> Column:
    return F.substring_index(text, "/", -1)


def base_type(trial_type: Column) -> Column:
    """``'stimulus/2'`` -> ``'stimulus'``."""
    return F.substring_index(trial_type, "/", 1)


def contains(text: Column, part: str) -> Column:
    return F.instr(text, part) > 0


def grid_coordinates(name: Column) -> tuple[Column, Column]:
    """``'R3-C12'`` -> (3, 12)."""
    pattern = r"^.(\d+)-.(\d+)"
    return (
        F.regexp_extract(name, pattern, 1).cast("int"),
        F.regexp_extract(name, pattern, 2).cast("int"),
    )


SHAFT_PATTERN = r"^([a-zA-Z]+)(\d+)"


def shaft_contact(name: Column) -> tuple[Column, Column]:
    """``'LA12'`` -> (``'LA'``, 12); (NULL, NULL) when the name has another form."""
    shaft = F.regexp_extract(name, SHAFT_PATTERN, 1)
    return (
        F.when(shaft != "", shaft),
        F.when(shaft != "", F.regexp_extract(name, SHAFT_PATTERN, 2).cast("long")),
    )


def strip_entities(name: Column) -> Column:
    """Delete the ``_acq-*`` and ``_run-*`` parts of a file name."""
    return F.regexp_replace(name, r"_(?:acq|run)-[^_.]+", "")


def snake_to_camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.right(p, F.length(p) - 1))),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def two_digits(x: Column) -> Column:
    """Positive number with two significant digits and no trailing zeros (``%.2g``)."""
    exponent = F.floor(F.log10(x))
    step = F.pow(F.lit(10.0), (exponent - 1).cast("double"))
    rounded = F.bround(x / step) * step
    exponent = F.floor(F.log10(rounded) + F.lit(1e-9))
    mantissa = F.bround(rounded / F.pow(F.lit(10.0), (exponent).cast("double")), 1)
    plain = F.regexp_replace(F.format_number(rounded, 6), ",", "")
    sign = F.when(exponent < 0, "-").otherwise("+")

    def trim(text: Column) -> Column:
        return F.regexp_replace(text, r"\.?0+$", "")

    scientific = F.concat(
        trim(F.format_number(mantissa, 1)),
        F.lit("e"),
        sign,
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(x == 0, "0")
        .when((exponent >= 2) | (exponent < -4), scientific)
        .otherwise(trim(plain))
    )


def window_text(start: Column, stop: Column) -> Column:
    """Time window as ``[pre0.5,post0.5]``."""

    def edge(x: Column) -> Column:
        return F.concat(F.when(x < 0, "pre").otherwise("post"), two_digits(F.abs(x)))

    return F.concat(F.lit("["), edge(start), F.lit(","), edge(stop), F.lit("]"))


def result_phase(description: Column) -> Column:
    return F.when(contains(F.lower(description), "perception"), "Perception").otherwise("Production")


def result_norm(description: Column) -> Column:
    low = F.lower(description)
    return (
        F.when(contains(low, "zscore"), "Zscore")
        .when(contains(low, "meansub"), "MeanSub")
        .otherwise("raw")
    )


def result_description(
    band: Column, description: Column, start: Column, stop: Column, datatype: Column
) -> Column:
    """Key text of one within-subject decoding result."""
    return F.concat(
        band, F.lit("("), result_phase(description), F.lit(")("), result_norm(description),
        F.lit(")(tw"), window_text(start, stop), F.lit(")("),
        F.when(contains(datatype, "sig"), "sig").otherwise("all"), F.lit("Channel)"),
    )


def cross_result_description(
    band: Column, description: Column, align: tuple[Column, Column],
    decode: tuple[Column, Column], datatype: Column, sources: Column,
) -> Column:
    """Key text of one cross-subject decoding result; ``sources`` is an array of subjects."""
    return F.concat(
        band, F.lit("("), result_phase(description), F.lit(")("), result_norm(description),
        F.lit(")(alignTW"), window_text(*align), F.lit(")(decTW"), window_text(*decode),
        F.lit(")("), F.when(contains(datatype, "sig"), "sig").otherwise("all"),
        F.lit("Channel)(pts["), F.array_join(sources, ","), F.lit("])"),
    )


def position_suffix(position: Column) -> Column:
    """Phoneme position as ``pAll`` (-1) or ``p2``."""
    return F.when(position == -1, "pAll").otherwise(F.concat(F.lit("p"), position.cast("string")))
