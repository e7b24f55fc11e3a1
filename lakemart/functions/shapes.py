"""Editing JSON definitions of a known shape as typed columns, inside the JVM.

A shape is a struct type: objects, lists, texts, whole numbers and booleans. A text of
the shape has its fields in the shape's order, none twice and none besides; fields may
be missing unless the shape says ``not null``. Such a text loses nothing when it is
read by :func:`from_json`, which is what makes editing it as columns safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart.functions.rewriting import (
    ACTIVITIES,
    ARTIFACT_ID,
    CONNECTION,
    ENDPOINT,
    EXTERNAL_REFERENCES,
    LINKED_SERVICE,
    LINKED_TYPES,
    NOTEBOOK_ACTIVITY,
    NOTEBOOK_ID,
    WORKSPACE_ID,
)

# Printable ASCII without quotes and backslashes: read and written alike by every JSON library.
TEXT = r'"[ !#-\[\]-~]*+"'
SPACE = r"[ \t\r\n]*+"
WHOLE = r"(?:0|-?+[1-9][0-9]{0,17}+)"
BOOLEAN = r"(?:true|false)"

Edit = Callable[[Column], Column]


def as_shape(shape: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(shape) if isinstance(shape, str) else shape


def shape_pattern(shape: T.StructType) -> str:
    """A pattern that matches exactly the texts of a shape, without backtracking."""
    return rf"\A{SPACE}{_pattern(shape)}{SPACE}\z"


def _pattern(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        members = ""
        for field in kind.fields:
            if not all(" " <= c <= "~" and c not in '"\\' for c in field.name):
                raise ValueError(f"not a plain name: {field.name!r}")
            # a comma if another member follows, none at the end
            member = rf'"\Q{field.name}\E"{SPACE}:{SPACE}{_pattern(field.dataType)}{SPACE}(?:,{SPACE}(?=")|(?=\}}))'
            members += f"(?:{member})" + ("?+" if field.nullable else "")
        return rf"\{{{SPACE}{members}\}}"
    if isinstance(kind, T.ArrayType):
        element = rf"{_pattern(kind.elementType)}{SPACE}(?:,{SPACE}(?!\])|(?=\]))"
        return rf"\[{SPACE}(?:{element})*+\]"
    if isinstance(kind, T.StringType):
        return TEXT
    if isinstance(kind, T.LongType):
        return WHOLE
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    raise ValueError(f"a shape has no {kind.simpleString()}")


# A quote between these may end a text or begin one: an end of text may look like an opening, or the reverse.
UNCLEAR = [f'{before}"{after}' for before in ",{" for after in ",:}]"] + ['[":', ':":']


def spaced(text: Column, shape: T.DataType) -> Column:
    """Compact JSON of a shape with a blank behind each comma and colon outside of texts.

    Where all quotes are clear, a name ends at ``":``, the next text or name begins at
    ``,"`` and the next object at ``},{"``; nothing inside of texts looks like that. Other
    texts are taken apart by a pattern, which takes several times as long.
    """
    unit = r'("(?:[^"\\]++|\\.)*+"[\]}]*+|[^",:]++)([,:]|\z)'
    apart = F.rtrim(F.regexp_replace(text, F.lit(unit), F.lit("$1$2 ")))
    if _has_other_commas(shape):
        return apart
    signs = ["\\", "},{}", "],[", *UNCLEAR]
    unclear = reduce(or_, [text.contains(s) for s in signs])
    clear = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), [('":', '": '), (',"', ', "'), ('},{"', '}, {"')], text)
    return F.when(unclear, apart).otherwise(clear)


def _has_other_commas(kind: T.DataType) -> bool:
    """Whether a comma may stand in front of something else than a text, a name, an object or a list."""
    if isinstance(kind, T.ArrayType):
        return not isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)) or _has_other_commas(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_other_commas(f.dataType) for f in kind.fields)


def _field(kind: T.DataType, name: str) -> T.DataType | None:
    found = [f.dataType for f in kind.fields if f.name == name] if isinstance(kind, T.StructType) else []
    return found[0] if found else None


def _put(node: Column, name: str, value: Column) -> Column:
    return node.withField(f"`{name}`", value)


def _bound(value: Column, use: Edit) -> Column:
    """``use(value)`` with the value computed once, however often it is looked at."""
    return F.transform(F.array(value), use)[0]


class PipelineEdit:
    """The edits of :func:`lakemart.functions.rewriting.rewrite_pipeline` on typed columns.

    ``known`` maps the id of an item to a struct of its edits by type, each (new_id, endpoint).
    Spark interprets what is inside of a list, where joining texts is slow: items are looked
    up by their ids as they are, and only those without a counterpart are spelled out.
    """

    def __init__(
        self, shape: T.StructType, workspace: str, types: Sequence[str], known: Column, swaps: Mapping[str, str]
    ):
        self.shape, self.workspace, self.types, self.known = shape, F.lit(workspace), sorted(types), known
        moved = {old: new for old, new in swaps.items() if old != new}
        self.swaps = F.map_from_arrays(F.lit(list(moved)), F.lit(list(moved.values()))) if moved else None

    def apply(self, tree: Column) -> Column:
        edit = self._edit(self.shape)
        return tree if edit is None else edit(tree)

    def missing(self, tree: Column) -> Column:
        """``type:id`` of every item reference to be rewritten that has no counterpart."""
        collect = self._collect(self.shape)
        if collect is None:
            return F.array().cast("array<string>")
        # a list of references is null in nothing but the references themselves
        unknown = F.filter(collect(tree), lambda r: r.isNotNull() & self._found(r["kind"], r["id"], LINKED_TYPES.values()).isNull())
        return F.transform(unknown, lambda r: F.concat(r["kind"], F.lit(":"), r["id"]))

    def _kind(self, tag: Column) -> Column:
        named = [(tag == F.lit(t), F.lit(kind)) for t, kind in LINKED_TYPES.items() if kind in self.types]
        return reduce(lambda kind, case: F.when(case[0], case[1]).otherwise(kind), named, F.lit(None).cast("string"))

    def _outside(self, holder: Column) -> Column:
        return ~holder[WORKSPACE_ID].eqNullSafe(self.workspace)

    def _found(self, kind: Column, id_: Column, kinds: Iterable[str] = ()) -> Column:
        """The edit of an item of one of the kinds, of a notebook otherwise."""
        named = [(kind == F.lit(k), self.known[id_][k]) for k in kinds]
        return reduce(lambda found, case: F.when(case[0], case[1]).otherwise(found), named, self.known[id_]["Notebook"])

    def _reference(self, holder: Column, kind: Column, id_field: str) -> Column:
        reference = F.struct(kind.alias("kind"), holder[id_field].alias("id"))
        return F.when(self._outside(holder) & kind.isNotNull() & holder[id_field].isNotNull(), reference)

    def _moved(self, holder: Column, kind: Column, id_field: str) -> Column:
        def moved(found: Column) -> Column:
            new = _put(_put(holder, id_field, found["new_id"]), WORKSPACE_ID, self.workspace)
            if id_field == ARTIFACT_ID:
                endpoint = F.when(kind == "Warehouse", found["endpoint"])
                new = _put(new, ENDPOINT, F.coalesce(endpoint, holder[ENDPOINT]))
            return F.when(found.isNotNull(), new).otherwise(holder)

        kinds = LINKED_TYPES.values() if id_field == ARTIFACT_ID else ()
        found = F.when(self._outside(holder) & kind.isNotNull(), self._found(kind, holder[id_field], kinds))
        return _bound(found, moved)

    def _holder(self, kind: T.DataType | None, id_field: str, *others: str) -> bool:
        """Whether a place can hold an item's id; if so, it must have the other fields, too."""
        if kind is None or not isinstance(_field(kind, id_field), T.StringType):
            return False
        for name in others:
            if not isinstance(_field(kind, name), T.StringType):
                raise ValueError(f"beside {id_field!r} the shape needs a text {name!r}")
        return True

    def _is_linked(self, name: str, kind: T.DataType) -> bool:
        properties = _field(kind, "properties") if name == LINKED_SERVICE else None
        holder = None if properties is None else _field(properties, "typeProperties")
        tagged = properties is not None and isinstance(_field(properties, "type"), T.StringType)
        return tagged and self._holder(holder, ARTIFACT_ID, WORKSPACE_ID, ENDPOINT)

    def _is_activities(self, name: str, kind: T.DataType) -> bool:
        if name != ACTIVITIES or not isinstance(kind, T.ArrayType) or "Notebook" not in self.types:
            return False
        tagged = isinstance(_field(kind.elementType, "type"), T.StringType)
        return tagged and self._holder(_field(kind.elementType, "typeProperties"), NOTEBOOK_ID, WORKSPACE_ID)

    def _edit(self, kind: T.DataType) -> Edit | None:
        """How a value of a type changes; none if nothing in it can."""
        if isinstance(kind, T.ArrayType):
            inner = self._edit(kind.elementType)
            return None if inner is None else lambda node: F.transform(node, inner)
        if not isinstance(kind, T.StructType):
            return None
        edits = {f.name: edit for f in kind.fields if (edit := self._edit_member(f.name, f.dataType))}
        if not edits:
            return None
        return lambda node: reduce(lambda new, e: _put(new, e[0], e[1](node[e[0]])), edits.items(), node)

    def _edit_member(self, name: str, kind: T.DataType) -> Edit | None:
        inner = self._edit(kind) or (lambda node: node)
        if self._is_linked(name, kind):

            def linked(node: Column) -> Column:
                new = inner(node)
                properties = new["properties"]
                holder = self._moved(properties["typeProperties"], self._kind(properties["type"]), ARTIFACT_ID)
                return _put(new, "properties", _put(properties, "typeProperties", holder))

            return linked
        if self._is_activities(name, kind):

            def activity(node: Column) -> Column:
                holder = self._moved(node["typeProperties"], F.lit("Notebook"), NOTEBOOK_ID)
                is_notebook = node["type"].eqNullSafe(F.lit(NOTEBOOK_ACTIVITY))
                return F.when(is_notebook, _put(node, "typeProperties", holder)).otherwise(node)

            return lambda node: F.transform(inner(node), activity)
        if name == EXTERNAL_REFERENCES and isinstance(_field(kind, CONNECTION), T.StringType):
            if (swaps := self.swaps) is not None:

                def swapped(node: Column) -> Column:
                    new = inner(node)
                    return _put(new, CONNECTION, F.coalesce(swaps[new[CONNECTION]], new[CONNECTION]))

                return swapped
        return self._edit(kind)

    def _collect(self, kind: T.DataType) -> Edit | None:
        """The references in a value of a type as an array; none if it has no place for any."""
        if isinstance(kind, T.ArrayType):
            inner = self._collect(kind.elementType)
            return None if inner is None else lambda node: F.flatten(F.transform(node, inner))
        if not isinstance(kind, T.StructType):
            return None
        parts: list[Edit] = []
        for f in kind.fields:
            parts.extend(self._collect_member(f.name, f.dataType))
        if not parts:
            return None
        nothing = F.array().cast("array<struct<kind:string,id:string>>")
        return lambda node: F.concat(*[F.coalesce(part(node), nothing) for part in parts])

    def _collect_member(self, name: str, kind: T.DataType) -> list[Edit]:
        found: list[Edit] = []
        if (inner := self._collect(kind)) is not None:
            found.append(lambda node: inner(node[name]))
        if self._is_linked(name, kind):

            def linked(properties: Column) -> Column:
                return self._reference(properties["typeProperties"], self._kind(properties["type"]), ARTIFACT_ID)

            found.append(lambda node: F.transform(F.array(node[name]["properties"]), linked))
        if self._is_activities(name, kind):

            def activity(node: Column) -> Column:
                reference = self._reference(node["typeProperties"], F.lit("Notebook"), NOTEBOOK_ID)
                return F.when(node["type"] == NOTEBOOK_ACTIVITY, reference)

            found.append(lambda node: F.transform(node[name], activity))
        return found
