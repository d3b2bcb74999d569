"""Labels, colours and types by fixed tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category, label, colour.
CATEGORIES = (
    ("device_identity.hardware", "DEVICE_INFO", "#E74C3C"),
    ("device_identity.software", "OS_INFO", "#D35400"),
    ("device_identity.unique_id", "DEVICE_ID", "#C0392B"),
    ("device_identity.sim", "SIM_INFO", "#E74C3C"),
    ("device_identity.ad_tracking", "AD_ID", "#795548"),
    ("device_identity.distributed", "DISTRIBUTED", "#607D8B"),
    ("device_identity.screen", "SCREEN", "#9C27B0"),
    ("device_status.battery", "BATTERY", "#FF5722"),
    ("device_status.sensor", "SENSOR", "#E91E63"),
    ("network.connectivity", "NETWORK", "#2ECC71"),
    ("network.wifi", "WIFI", "#27AE60"),
    ("network.bluetooth", "BLUETOOTH", "#00BCD4"),
    ("user_data.account", "ACCOUNT", "#9B59B6"),
    ("user_data.clipboard", "CLIPBOARD", "#F39C12"),
    ("user_data.sms", "SMS", "#FF5722"),
    ("user_data.contacts", "CONTACTS", "#00BCD4"),
    ("user_preference.locale", "LOCALE", "#3F51B5"),
    ("user_preference.settings", "SETTINGS", "#3F51B5"),
    ("location", "LOCATION", "#3498DB"),
    ("media.camera", "CAMERA", "#1ABC9C"),
    ("media.audio", "MICROPHONE", "#E67E22"),
    ("app_environment", "APP_ENV", "#78909C"),
)
#: Fixed value: the colour of all other categories.
GREY = "#888"
#: Keywords that name a type, operators whose result is a number, and those whose result is a truth value.
KEYWORDS = ("boolean", "number", "string", "undefined", "null", "any", "void", "never")
NUMERIC = ("-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>")
TRUTH = ("!=", "!==", "<", ">", "<=", ">=", "&&", "||", "==", "===", "in")
#: Names of operators.
OPERATORS = (
    ("??", "NullishCoalescing"), ("**", "Exponentiation"), ("/", "Division"), ("+", "Addition"), ("-", "Subtraction"), ("*", "Multiplication"), ("%", "Remainder"),
    ("<<", "LeftShift"), (">>", "RightShift"), (">>>", "UnsignedRightShift"), ("&", "BitwiseAnd"), ("|", "BitwiseOr"), ("^", "BitwiseXor"), ("&&", "LogicalAnd"), ("||", "LogicalOr"),
    ("<", "LessThan"), ("<=", "LessThanOrEqual"), (">", "GreaterThan"), (">=", "GreaterThanOrEqual"), ("==", "Equality"), ("!=", "InEquality"), ("===", "StrictEquality"), ("!==", "StrictInequality"),
)


def _looked_up(key: Column, pairs) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), key)


def category_label(category: Column) -> Column:
    return F.coalesce(_looked_up(category, [(c, label) for c, label, _ in CATEGORIES]), F.upper(category))


def category_colour(category: Column) -> Column:
    return F.coalesce(_looked_up(category, [(c, colour) for c, _, colour in CATEGORIES]), F.lit(GREY))


def operator_name(token: Column) -> Column:
    """Null for what is no binary operator."""
    return _looked_up(token, OPERATORS)


def keyword_type(text: Column) -> Column:
    """The type a keyword names; any other text names a type that isn't clear."""
    return F.when(text.isin(*KEYWORDS), text).when(text == "RegularExpression", "class RegExp").otherwise(F.concat(F.lit("unclear "), text))


def binary_type(operator: Column, left: Column, right: Column) -> Column:
    """Result type of a binary operation on operand types; 'unknown' where neither rule holds."""
    numbers = (left == "number") & (right == "number")
    plus = F.when(numbers, "number").when((left == "string") | (right == "string"), "string")
    either = F.when(left.isin("unknown", "undefined", "null"), right).otherwise(left)
    known = F.when(operator == "+", plus).when(operator.isin(*NUMERIC), F.when(numbers, "number")).when(operator.isin(*TRUTH), "boolean").when(operator == "??", either)
    return F.coalesce(known, F.lit("unknown"))


def union_contained(a: Column, b: Column) -> Column:
    """Whether two unions ('x|y') have as many members and each of the second holds that of the first at its place."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: F.contains(q, p)), lambda ok: ok)


def is_unclear(kind: Column, members: Column) -> Column:
    """Whether a type is unclear or a union or array with an unclear member."""
    return kind.isin("unknown", "unclear") | (kind.isin("union", "array", "intersection") & F.exists(F.coalesce(members, F.array().cast("array<string>")), lambda m: m.isin("unknown", "unclear")))


def dotted_call(text: Column) -> Column:
    """['a', 'b', 'c'] of 'a.b.c()', else []."""
    pattern = r"^(\w+)\.(\w+)\.(\w+)\(\)$"
    return F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, k) for k in (1, 2, 3)))).otherwise(F.array().cast("array<string>"))


def last_bracket(text: Column) -> Column:
    """What stands between the last '<' and '()>' at the end, else ''."""
    return F.trim(F.regexp_extract(text, r"<([^<>]*)\(\)>$", 1))


def unordered(a: Column, b: Column) -> Column:
    """One key for a pair in either order."""
    return F.array_join(F.sort_array(F.array(a, b)), "||")


def method_signature(file: Column, owner: Column, name: Column, types: Column, static: Column) -> Column:
    """'@file: owner.[static]name(t1, t2)'."""
    return F.concat(F.lit("@"), file, F.lit(": "), owner, F.lit("."), F.when(static, "[static]").otherwise(""), name, F.lit("("), F.array_join(types, ", "), F.lit(")"))
