"""Where data goes: ordered rules on the text of a statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind, names that must occur, methods that must be called; earlier entries win.
NETWORK = (
    ("http", "rcp", "webSocket", "socket", "request", "HttpRequest", "Session", "WebSocket", "TCPSocket", "UDPSocket", "TLSSocket"),
    ("request", "requestInStream", "fetch", "send", "uploadFile"),
)
SESSION = ("get", "post", "put", "delete")
STORAGE = (
    ("preferences", "Preferences", "rdb", "RdbStore", "fs", "relationalStore", "dataPreferences"),
    ("put", "putSync", "insert", "update", "write", "writeSync", "flushSync"),
)
DISPLAY = (("Text", "TextInput", "TextArea", "RichText", "Image", "List", "Column", "Row", "Flex"), ("create", "setText", "setValue"))
LOG = (("console", "hilog", "Logger"), ("log", "info", "warn", "error", "debug"))


def rules() -> list[tuple[str, str, str, str]]:
    """(kind, text that must occur, call that must occur, api) in order."""
    out = []
    for name in NETWORK[0]:
        out += [("network", name, f".{m}(", f"{name}.{m}") for m in NETWORK[1]]
        if name in ("Session", "rcp"):
            out += [("network", name, f".{m}(", f"rcp.Session.{m}") for m in SESSION]
    for kind, (names, methods), dot in (("storage", STORAGE, ""), ("ui_display", DISPLAY, ""), ("log", LOG, ".")):
        out += [(kind, f"{n}{dot}", f".{m}(", f"{n}.{m}") for n in names for m in methods]
    return out


def classify(text: Column) -> Column:
    """struct(kind, api) of the first rule that holds, else null: the rules' CASE, tried where the text has any call."""
    calls = list(dict.fromkeys(call for _, _, call, _ in rules()))
    called = F.lit(False)
    for call in calls:
        called = called | F.contains(text, F.lit(call))
    number = F.when(F.lit(False), -1)
    for k, (_, name, call, _) in enumerate(rules(), 1):
        number = number.when(F.contains(text, F.lit(call)) & F.contains(text, F.lit(name)), k)
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("api")) for k, _, _, a in rules()))
    return F.get(table, F.when(called, number) - 1)


def case_sql(text: str, column: int) -> str:
    """The same as a CASE expression; column 0: kind, 3: api."""
    return "CASE " + " ".join(f"WHEN contains({text}, '{r[1]}') AND contains({text}, '{r[2]}') THEN '{r[column]}'" for r in rules()) + " END"
