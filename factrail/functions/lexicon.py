"""Fixed values and the tables derived from them: number words, units, elements, stop words."""

from __future__ import annotations

# Number words and their values.
ONES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}

# Canonical unit -> written forms.
UNITS = {
    "meter": ["meter", "meters", "metre", "metres", "m"],
    "kilometer": ["kilometer", "kilometers", "kilometre", "kilometres", "km"],
    "centimeter": ["centimeter", "centimeters", "centimetre", "cm"],
    "millimeter": ["millimeter", "millimeters", "mm"],
    "kilogram": ["kilogram", "kilograms", "kilo", "kilos", "kg"],
    "gram": ["gram", "grams", "g"],
    "milligram": ["milligram", "milligrams", "mg"],
    "liter": ["liter", "liters", "litre", "litres", "l"],
    "milliliter": ["milliliter", "milliliters", "millilitre", "ml"],
    "hour": ["hour", "hours", "hr", "hrs", "h"],
    "minute": ["minute", "minutes", "min"],
    "second": ["second", "seconds", "sec", "secs", "s"],
    "day": ["day", "days"],
    "week": ["week", "weeks"],
    "month": ["month", "months"],
    "year": ["year", "years"],
    "gigabyte": ["gigabyte", "gigabytes", "gb"],
    "megabyte": ["megabyte", "megabytes", "mb"],
    "kilobyte": ["kilobyte", "kilobytes", "kb"],
    "byte": ["byte", "bytes"],
    "percent": ["percent", "per cent", "percentage", "%"],
    "kilometer per hour": ["kilometer per hour", "kilometers per hour", "km/h", "kph"],
    "meter per second": ["meter per second", "meters per second", "m/s"],
    "degree celsius": ["degree celsius", "degrees celsius", "celsius", "°c"],
    "degree fahrenheit": ["degree fahrenheit", "degrees fahrenheit", "fahrenheit", "°f"],
}
UNIT_OF = {form: unit for unit, forms in UNITS.items() for form in forms}

# Negation cues, in matching order.
NEGATION_CUES = (
    "not", "isn't", "is not", "aren't", "are not", "except", "excluding", "doesn't", "does not", "cannot",
    "can't", "no", "never", "none",
)

# Words that carry no content.
STOP_WORDS = (
    "a an the is are was were be been being of in on at to for from with without and or but if "
    "it its this that these those as by than then so such not no do does did done have has had "
    "there here what which who whom whose when where why how i you he she they we me my your his "
    "her their our us them answer question following category called known also more most very"
).split()

# Chemical element symbols.
ELEMENT_SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()

# Symbols whose names count as the same fact.
ELEMENT_NAMES = {
    "h": "hydrogen", "he": "helium", "c": "carbon", "n": "nitrogen", "o": "oxygen", "ne": "neon", "na": "sodium",
    "si": "silicon", "s": "sulfur", "k": "potassium", "ca": "calcium", "fe": "iron", "ni": "nickel",
    "cu": "copper", "zn": "zinc", "ag": "silver", "sn": "tin", "w": "tungsten", "au": "gold", "hg": "mercury",
    "pb": "lead",
}

# Long words that are easier to read aloud in two parts.
MORPHEMES = {
    "kilometer": "kilo meter", "centimeter": "centi meter", "millimeter": "milli meter", "milliliter": "milli liter",
    "kilogram": "kilo gram", "megabyte": "mega byte", "gigabyte": "giga byte", "percentage": "percent age",
}

# Patterns over ASCII-shadowed text, valid for Java and RE2 alike.
DIGITS = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_WORDS = "|".join([*ONES, *TENS, *SCALES])
NUMBER_WORDS = (
    rf"\b(?:(?:{_WORDS})[\s-]*)+(?:point(?:\s+(?:{'|'.join(ONES)}))+)?(?:and\s+a\s+(?:half|quarter))?\b"
)
CUES = r"\b(?:" + "|".join(NEGATION_CUES) + r")\b"
SYMBOL = r"\b[A-Z][a-z]?\b"
UNIT = r"\b(?:" + "|".join(sorted(UNIT_OF, key=len, reverse=True)) + r")\b"


def words_below_thousand() -> list[str]:
    """English words of 0..999, '' for zero; hundreds and the rest are joined by 'and'."""
    small = {v: w for w, v in {**ONES, **TENS}.items()}

    def two(n: int) -> str:
        if n in small:
            return small[n]
        return f"{small[n - n % 10]}-{small[n % 10]}"

    out = [""]
    for n in range(1, 1000):
        hundreds, rest = divmod(n, 100)
        parts = [f"{small[hundreds]} hundred"] if hundreds else []
        out.append(" and ".join(parts + ([two(rest)] if rest else [])))
    return out


def scale_words() -> list[str]:
    """'', thousand, million, ... centillion: one word per group of three digits, by the Latin rule."""
    units = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem"]
    tens = ["dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint", "octogint", "nonagint"]
    low = ["m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non"]
    stems = low + [u + t for t in tens for u in units] + ["cent"]
    return ["", "thousand"] + [s + "illion" for s in stems]
