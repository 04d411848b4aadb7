"""Fixed dimensions: conditions, views, fact types and the schemas of the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# Fact types, in merge priority order.
FACT_TYPES = ("number", "unit", "negation", "proper_noun", "content")
HARD_TYPES = ("number", "unit", "proper_noun", "negation")
RULE_TYPES = ("number", "unit", "negation")

# The three independent observers and the readback modes over them.
VIEWS = ("asr1", "asr2", "asr3")
MODES = {
    "asr1": ("asr1",),
    "asr2": ("asr2",),
    "asr3": ("asr3",),
    "union12": ("asr1", "asr2"),
    "union13": ("asr1", "asr3"),
    "union123": ("asr1", "asr2", "asr3"),
}

# Condition -> (wants audio, readback reference, forced source, modality, origin).
CONDITIONS = {
    "READ": (False, None, None, None, None),
    "LISTEN": (False, None, None, None, None),
    "SPEAK": (True, "LISTEN", None, "audio", "self"),
    "ECHO": (True, "READ", None, "text", "self"),
    "EF": (True, "READ", "READ", "text", "given"),
    "EFA": (True, "LISTEN", "LISTEN", "audio", "given"),
    "EFB": (True, "READ", "READ", None, None),
    "EFW": (True, "READ", "READ", None, None),
    "SPEAKD": (True, "LISTEN", None, None, None),
}
SPEECH = tuple(c for c, d in CONDITIONS.items() if d[0])

DEFAULT_INSTRUCTION = "Answer the question in one short sentence."
READING_PROMPT = (
    "Read the following sentence aloud exactly as written, word for word. "
    "Do not add, remove, translate, or rephrase anything.\n\n"
    "Sentence: {answer}"
)

SLOTS: tuple[tuple[str, str], ...] = tuple(
    [("READ", "text"), ("LISTEN", "text")]
    + [(c, v) for c in SPEECH for v in ("internal", *VIEWS)]
)


def slot_bit(condition: str, view: str) -> int:
    return 1 << SLOTS.index((condition, view))


def slot_bit_column(condition: str = "condition", view: str = "view") -> Column:
    """BIGINT with the bit of (condition, view); 0 for a pair outside the dimension."""
    cases = " ".join(f"WHEN {condition} = '{c}' AND {view} = '{v}' THEN {slot_bit(c, v)}L" for c, v in SLOTS)
    return F.expr(f"CASE {cases} ELSE 0L END")


@dataclass(frozen=True)
class Side:
    """Slots read as a union (``bits``) and the slots that must have been observed (``need``)."""

    bits: int
    need: int

    @staticmethod
    def of(condition: str, *views: str) -> "Side":
        bits = 0
        for v in views:
            bits |= slot_bit(condition, v)
        return Side(bits, bits)

    def on(self, *others: "Side") -> "Side":
        """The same union, restricted to items on which the other sides were observed too."""
        need = self.need
        for o in others:
            need |= o.need
        return Side(self.bits, need)


TEXT_READ = Side.of("READ", "text")
TEXT_LISTEN = Side.of("LISTEN", "text")


def spoken(condition: str, mode: str = "asr1") -> Side:
    """A readback mode of a condition. Every mode needs the primary view beside its own views."""
    if mode not in MODES:
        raise ValueError(f"unknown readback mode {mode!r}, expected one of {tuple(MODES)}")
    return Side.of(condition, *MODES[mode]).on(Side.of(condition, "asr1"))


def planned(condition: str) -> Side:
    return Side.of(condition, "internal")


@dataclass(frozen=True)
class Pair:
    """Downstream against upstream, over some fact types, on some items."""

    name: str
    down: Side
    up: Side
    types: tuple[str, ...] | None = None
    agree_only: bool = False


def headline_pairs(mode: str = "asr1") -> list[Pair]:
    speak, listen = spoken("SPEAK", mode), TEXT_LISTEN
    return [
        Pair("perception", TEXT_LISTEN, TEXT_READ),
        Pair("speech", speak, listen),
        Pair("echo", spoken("ECHO", mode), TEXT_READ),
        Pair("forced", spoken("EF", mode), TEXT_READ),
        Pair("speech_hard", speak, listen, HARD_TYPES),
        Pair("speech_content", speak, listen, ("content",)),
        Pair("speech_agree", speak, listen, None, True),
    ]


def decomposition_pairs(mode: str = "asr1") -> list[Pair]:
    out = [
        Pair("perception", TEXT_LISTEN, TEXT_READ),
        Pair("plan", planned("SPEAK"), TEXT_LISTEN),
        Pair("render_SPEAK", spoken("SPEAK", mode), planned("SPEAK")),
        Pair("total_SPEAK", spoken("SPEAK", mode), TEXT_LISTEN),
        Pair("comply_EF", planned("EF"), TEXT_READ),
        Pair("comply_ECHO", planned("ECHO"), TEXT_READ),
    ]
    for c in ("ECHO", "EF", "EFA", "EFB", "EFW"):
        out.append(Pair(f"render_{c}", spoken(c, mode), planned(c)))
    out.append(Pair("speech_agree", spoken("SPEAK", mode), TEXT_LISTEN, None, True))
    return out


FACT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("polarity", T.StringType()),
])
FACTS = T.ArrayType(FACT)
READBACK = T.StructType(
    [T.StructField(v, T.StringType()) for v in VIEWS]
    + [T.StructField(f"{v}_error", T.StringType()) for v in VIEWS]
    + [T.StructField(f"{v}_sec", T.DoubleType()) for v in VIEWS]
    + [
        T.StructField("asr_versions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("asr_agree", T.BooleanType()),
        T.StructField("agreement_wer", T.DoubleType()),
        T.StructField("reference_condition", T.StringType()),
        T.StructField("reference_text", T.StringType()),
        T.StructField("readback_wer", T.DoubleType()),
        T.StructField("readback_wer_vs_self", T.DoubleType()),
        T.StructField("audio_intelligible", T.BooleanType()),
        T.StructField("intelligible_wer_threshold", T.DoubleType()),
    ]
)
ITEMS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("question_text", T.StringType()),
    T.StructField("expected_answer_text", T.StringType()),
    T.StructField("instruction_text", T.StringType()),
    T.StructField("gold_facts", FACTS),
    T.StructField("question_audio", T.StructType([T.StructField("path", T.StringType())])),
    T.StructField("_corrupt_record", T.StringType()),
])
PREDICTIONS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_raw", T.StringType()),
    T.StructField("audio", T.StringType()),
    T.StructField("audio_duration_sec", T.DoubleType()),
    T.StructField("long_audio", T.BooleanType()),
    T.StructField("latency_sec", T.DoubleType()),
    T.StructField("config_hash", T.StringType()),
    T.StructField("stack", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("readback", READBACK),
    T.StructField("_corrupt_record", T.StringType()),
])
CANDIDATES = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("audio_duration_sec", T.DoubleType()),
        T.StructField("seed", T.LongType()),
    ]
    + [T.StructField(v, T.StringType()) for v in VIEWS]
    + [T.StructField(f"{v}_error", T.StringType()) for v in VIEWS]
    + [T.StructField(f"{v}_sec", T.DoubleType()) for v in VIEWS]
    + [T.StructField("_corrupt_record", T.StringType())]
)
EXTRACTIONS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("prompt_sha256", T.StringType()),
    T.StructField("fact_origin", T.StringType()),
    T.StructField("llm_model", T.StringType()),
    T.StructField("facts_rules", FACTS),
    T.StructField("facts_llm", FACTS),
    T.StructField("facts", FACTS),
    T.StructField("conflict", FACTS),
    T.StructField("type_conflicts", FACTS),
    T.StructField("llm_error", T.StringType()),
    T.StructField("asr_agree", T.BooleanType()),
    T.StructField("readback_wer", T.DoubleType()),
    T.StructField("role", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])
