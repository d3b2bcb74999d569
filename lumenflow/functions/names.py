"""Scalar functions on method signatures and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Method names that make a method an entry point, by priority.
INTERACTION = ("onClick", "onTouch", "onDragStart", "onDragEnter", "onDragMove", "onDragLeave", "onDrop", "onDragEnd", "onKeyEvent", "onFocusAxisEvent", "onChange", "onSubmit", "onSelect", "onCheckedChange")
MORE_INTERACTION = ("onTextSelectionChange", "onScrollEdge", "onScrollFrameBegin", "onReachStart", "onReachEnd")
COMPONENT = ("build", "aboutToAppear", "aboutToDisappear", "aboutToReuse", "aboutToRecycle", "onWillApplyTheme", "onLayout", "onPlaceChildren", "onMeasure", "onMeasureSize", "onPageShow", "onPageHide", "onFormRecycle", "onFormRecover", "onBackPress", "pageTransition", "onDidBuild")
ABILITY = ("onCreate", "onDestroy", "onWindowStageCreate", "onWindowStageDestroy", "onForeground", "onBackground", "onBackup", "onRestore", "onContinue", "onNewWant", "onDump", "onSaveState", "onShare", "onPrepareToTerminate", "onBackPressed", "onSessionCreate", "onSessionDestory", "onAddForm", "onCastToNormalForm", "onUpdateForm", "onChangeFormVisibility", "onFormEvent", "onRemoveForm", "onConfigurationUpdate", "onAcquireFormState", "onWindowStageWillDestroy")
SERVICE = ("onConnect", "onDisconnect", "onRequest")
INITIAL = ("_DEFAULT_ARK_METHOD", "constructor")
DEFAULT = ("%dflt", "[static]%dflt", "initialRender")
#: Callees that the framework calls.
LIFECYCLE_CALLEES = ("aboutToAppear", "build", "onCreate", "onForeground")
#: Method names without meaning of their own.
NON_SEMANTIC = r"^build$|^aboutToAppear$|^aboutToDisappear$|^onPageShow$|^onPageHide$|^onBackPress$|^initialRender$|^func_main_0$|^%dflt$|^%AM\d+\$|^_?static_?%?|^__init__$|^constructor$"
#: Words of a condition that guards a call.
GUARD = r"(?i)permission|granted|authorized|allowed|checkAccessToken|requestPermission|isLocationEnabled|hasPermission|canUse|isAvailable|isSupported|verify|enable|isActive"


def display_name(sig: Column) -> Column:
    """What stands behind the last ': ' up to the first '('."""
    return F.substring_index(F.substring_index(sig, ": ", -1), "(", 1)


def method_name(sig: Column) -> Column:
    """The last part between dots, up to '('."""
    return F.substring_index(F.substring_index(sig, ".", -1), "(", 1)


def file_path(sig: Column) -> Column:
    """What stands before the first ': ', without the project's name."""
    head = F.substring_index(sig, ": ", 1)
    return F.when(head.contains("/"), F.regexp_replace(head, "^[^/]*/", "")).otherwise(head)


def page_name(path: Column) -> Column:
    base = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.regexp_replace(F.regexp_replace(base, r"\.ets$", ""), r"\.ts$", "")


def readable(display: Column) -> Column:
    """A label for generated names; null for others."""
    callback = r"^(.+)\.%AM(\d+)\$(.+)$"
    return (
        F.when(display.rlike(callback), F.regexp_replace(display, callback, "$1.$3_callback_$2"))
        .when(display.rlike(r"^%dflt\.(.+)$"), F.concat(F.lit("[module]."), F.regexp_extract(display, r"^%dflt\.(.+)$", 1)))
        .when(display.contains("%dflt.[static]%dflt") | display.contains("%dflt.func_main_0"), F.lit("[module-level init]"))
    )


def call_type(callee: Column) -> Column:
    return F.when(callee.contains("%AM"), "callback").when(callee.isin(*LIFECYCLE_CALLEES), "lifecycle_implicit").otherwise("direct")


def is_entry(name: Column) -> Column:
    return name.isin(*INTERACTION, *MORE_INTERACTION, *COMPONENT, *ABILITY, *SERVICE, *INITIAL, *DEFAULT)


def entry_priority(name: Column) -> Column:
    return F.when(name.isin(*INTERACTION), 1).when(name.isin(*COMPONENT), 2).when(name.isin(*ABILITY), 3).when(name.isin(*INITIAL), 4).otherwise(99)


def entry_type(name: Column) -> Column:
    labels = ((1, "user_interaction"), (2, "component_lifecycle"), (3, "app_lifecycle"), (4, "initialization"))
    return F.coalesce(*(F.when(entry_priority(name) == p, label) for p, label in labels), F.lit("unknown"))


def is_semantic(name: Column) -> Column:
    return ~F.substring_index(name, ".", -1).rlike(NON_SEMANTIC)


def is_guard(condition: Column) -> Column:
    return condition.rlike(GUARD)


def dot_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(f'"{prefix}_'), F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), F.lit('"'))


def dot_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_label(name: Column) -> Column:
    """Callbacks named after their method; of several parts the last two."""
    return F.substring_index(F.regexp_replace(name, r"%AM(\d+)\$(\w+)", "$2_cb$1"), ".", -2)


def risk(categories: Column) -> Column:
    return F.when(categories >= 4, "high").when(categories >= 3, "medium").otherwise("low")
