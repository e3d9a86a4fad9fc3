"""XSD documents to a schema: the schema is shredded like any document and read from its rows."""

from __future__ import annotations

from sylva.functions.types import REGISTRY, XsdType, register
from sylva.sources.dtd import Dtd, model_regex
from sylva.sources.shred import Shredder

XSD_NS = "http://www.w3.org/2001/XMLSchema"
_FACETS = {"length": "length", "minLength": "min_length", "maxLength": "max_length", "totalDigits": "total_digits", "fractionDigits": "fraction_digits", "minInclusive": "low", "maxInclusive": "high"}


class XsdError(ValueError):
    pass


def repetition(low: str | None, high: str | None) -> str:
    """minOccurs and maxOccurs as a repetition mark."""
    a, b = int(low or 1), None if high == "unbounded" else int(high or 1)
    if b is not None and b < a:
        raise XsdError("maxOccurs is below minOccurs")
    return {(1, 1): "", (0, 1): "?", (0, None): "*", (1, None): "+"}.get((a, b), f"{{{a},{'' if b is None else b}}}")


class XsdSchema:
    """``dtd``: elements (with content models) and attributes; ``types``: simple types, registered with their facets.

    Local elements keep the scope of the type that declares them: ``local_elements`` maps
    (type or element, name) to the local type.
    """

    def __init__(self, text: str):
        c = Shredder().shred(text)
        self.rows = [dict(zip(c, values, strict=True)) for values in zip(*c.values(), strict=True)]
        self.kids: dict[int, list[dict]] = {}
        for r in self.rows:
            if r["node_type"] == 1:
                self.kids.setdefault(-1 if r["parent"] is None else r["parent"], []).append(r)
        top = self.rows[0]
        if top["local"] != "schema" or top["ns_uri"] != XSD_NS:
            raise XsdError("not a schema document")
        self.dtd, self.types, self.models, self.attributes, self.local_elements, self.pending = Dtd(), {}, {}, {}, {}, []
        for node in self.of(top):
            kind = node["local"]
            if kind == "simpleType":
                self.simple(node, self.get(node, "name"))
            elif kind == "complexType":
                self.complex(node, self.get(node, "name"))
            elif kind == "element":
                self.element(node, None)
        self.resolve()

    @staticmethod
    def get(node: dict, name: str) -> str | None:
        return next((a[4] for a in node["attrs"] if a[0] == name), None)

    def of(self, node: dict, *kinds: str) -> list[dict]:
        return [k for k in self.kids.get(node["pre"], []) if not kinds or k["local"] in kinds]

    @staticmethod
    def type_name(ref: str | None) -> str | None:
        return ref.split(":")[-1] if ref else None

    def simple(self, node: dict, name: str | None) -> str:
        name = name or f"anonymous{node['pre']}"
        for r in self.of(node, "restriction"):
            base = self.type_name(self.get(r, "base")) or "string"
            facets = {"enumeration": [], "pattern": []}
            for f in self.of(r):
                v = self.get(f, "value")
                if f["local"] in facets:
                    facets[f["local"]].append(v)
                elif f["local"] in _FACETS:
                    facets[_FACETS[f["local"]]] = v if f["local"].endswith("Inclusive") else int(v)
                elif f["local"] in ("minExclusive", "maxExclusive"):
                    facets["low" if f["local"] == "minExclusive" else "high"] = str(int(v) + (1 if f["local"] == "minExclusive" else -1))
                elif f["local"] == "whiteSpace":
                    facets["space"] = v
            self.types[name] = (base, facets)
        for u in self.of(node, "list"):
            self.types[name] = (self.type_name(self.get(u, "itemType")) or "token", {"variety": "list", "enumeration": [], "pattern": []})
        for _ in self.of(node, "union"):
            self.types[name] = ("string", {"enumeration": [], "pattern": []})
        return name

    def particle(self, node: dict, owner: str) -> str:
        mark = repetition(self.get(node, "minOccurs"), self.get(node, "maxOccurs"))
        if node["local"] == "element":
            return (self.type_name(self.get(node, "ref")) or self.element(node, owner)) + mark
        parts = [self.particle(k, owner) for k in self.of(node, "element", "sequence", "choice", "all")]
        sep = {"sequence": ", ", "choice": " | ", "all": " & "}[node["local"]]
        return f"({sep.join(parts)}){mark}" if parts else "EMPTY"

    def complex(self, node: dict, name: str | None) -> str:
        name = name or f"anonymous{node['pre']}"
        model, attrs = None, []
        for inner in [node, *[e for c in self.of(node, "complexContent", "simpleContent") for e in self.of(c, "extension", "restriction")]]:
            if inner is not node and (base := self.type_name(self.get(inner, "base"))) in self.models and inner["local"] == "extension":
                model, attrs = self.models[base], [*self.attributes[base]]
            for k in self.of(inner, "sequence", "choice", "all"):
                made = self.particle(k, name)
                model = made if model in (None, "EMPTY") else f"({model}, {made})"
            attrs += [(self.get(a, "name") or self.type_name(self.get(a, "ref")), self.type_name(self.get(a, "type")) or "string", {"required": "#REQUIRED"}.get(self.get(a, "use"), "#FIXED" if self.get(a, "fixed") else "#IMPLIED"), self.get(a, "fixed") or self.get(a, "default")) for a in self.of(inner, "attribute")]
        mixed = self.get(node, "mixed") == "true" or bool(self.of(node, "simpleContent"))
        self.models[name], self.attributes[name] = model or ("#PCDATA" if mixed else "EMPTY"), attrs
        return name

    def element(self, node: dict, owner: str | None) -> str:
        name = self.get(node, "name")
        if name is None:
            raise XsdError("an element declaration needs a name")
        kind = self.type_name(self.get(node, "type"))
        for inner in self.of(node, "complexType"):
            kind = self.complex(inner, None)
        for inner in self.of(node, "simpleType"):
            kind = self.simple(inner, None)
        if owner is None:
            self.pending.append((name, kind))
        else:
            self.local_elements[(owner, name)] = kind
        return name

    def resolve(self) -> None:
        """Types by name, wherever they were declared; registers simple types, bases first."""
        left = dict(self.types)
        while left:
            ready = [n for n, (base, _) in left.items() if base in REGISTRY]
            if not ready:
                raise XsdError(f"unknown base types of {sorted(left)}")
            for n in ready:
                base, f = left.pop(n)
                b = REGISTRY[base]
                own = {k: v for k, v in f.items() if k not in ("enumeration", "pattern")}
                pattern = "|".join(f"(?:{p})" for p in f["pattern"]) or b.pattern
                register(XsdType(n, base, **({"spark": b.spark, "lexical": b.lexical, "pattern": pattern, "low": b.low, "high": b.high, "space": b.space, "enumeration": tuple(f["enumeration"]), "fraction_digits": b.fraction_digits} | own)))
        for name, kind in self.pending:
            model = self.models.get(kind, "#PCDATA" if kind in REGISTRY else "ANY")
            self.dtd.elements.append({"name": name, "model": model, "model_re": model_regex("(#PCDATA)" if model == "#PCDATA" else model), "omit_start": False, "omit_end": False, "including": [], "excluding": []})
            for attr, kind_of, default_kind, value in self.attributes.get(kind, []):
                self.dtd.define_attribute(name, attr, kind_of, default_kind, value)


def load_xsd(text: str) -> XsdSchema:
    return XsdSchema(text)
