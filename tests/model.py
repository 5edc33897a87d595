"""A sequential reading of the statute rules, for comparison on random paragraph streams."""

import re

HEADS = ("TITULO", "CAPITULO", "SECAO", "SUBSECAO")
COUNTERS = {"TITULO": "tit", "CAPITULO": "cap", "SECAO": "sec", "SUBSECAO": "subsec", "NORMA": "norma"}


def suffix(kind, text):
    digits = re.match(r"\D*(\d+)", text)
    return {"PARAGRAFO_UNICO": lambda: "pu", "PARAGRAFO_NUM": lambda: "p" + digits[1], "INCISO": lambda: re.match("l?[IVXLC]+", text)[0].replace("l", "I"), "ALINEA": lambda: text[0], "SUB_ALINEA": lambda: "sub" + digits[1], "ITEM_NUM": lambda: "item" + digits[1]}.get(kind, lambda: "")()


def build(rows, defs):
    """rows: dicts of unit_type, text, centered, struck, art_number, identifier, notes; defs: fn_id to (kind, summary)."""
    heads, blocks, count = [], [], dict.fromkeys(COUNTERS, 0)
    law, adt, block, public, private = "", False, None, 0, 0
    seen, context, at = set(), ["", "", "", ""], 0

    def numbered(row):
        nonlocal public, private
        out = []
        for n in row["notes"]:
            kind = defs.get(n, ("", ""))[0]
            if kind == "private":
                private += 1
                out.append((n, True, private))
            elif kind == "public":
                public += 1
                out.append((n, False, public))
        return out

    def head(seq, kind, level, text, subtitle=""):
        nonlocal block
        block = None
        if kind in COUNTERS:
            count[kind] += 1
            section = COUNTERS[kind] + str(count[kind])
        else:
            section = kind.lower()
        heads.append((seq, level, text, subtitle, section))

    while at < len(rows):
        row, seq = rows[at], at
        kind, text = row["unit_type"], row["text"]
        at += 1
        if kind == "EMPTY":
            continue
        if row["centered"] and (m := re.match(r"NORMA:\s*(.+)", text, re.I)):
            law, adt = m[1].strip(), False
            head(seq, "NORMA", "TITULO", law)
        elif row["centered"] and "ATO DAS DISPOSIÇÕES TRANSITÓRIAS" in text:
            adt = True
            head(seq, "ADT", "TITULO", "ATO DAS DISPOSIÇÕES TRANSITÓRIAS")
        elif kind in HEADS:
            subtitle, first = "", text
            if kind == "CAPITULO" and "\n" in text:
                first, _, rest = text.partition("\n")
                subtitle = rest.strip()
            elif at < len(rows) and rows[at]["unit_type"] == "SUBTITLE":
                subtitle = rows[at]["text"]
                at += 1
            head(seq, kind, kind, first, subtitle)
        elif kind == "SUBTITLE":
            head(seq, "SECAO", "SECAO", text)
        elif kind == "ARTIGO":
            number = ("ADT" if adt else "") + row["art_number"]
            unit = {"seq": seq, "uid": "art" + number, "old": row["struck"], "identifier": row["identifier"], "notes": numbered(row)}
            summary = next((defs[n][1] for n in row["notes"] if defs.get(n, ("",))[0] == "summary"), "")
            if block and block["number"] == number:
                block["versions"] += [{**u, "old": True} for u in [block["caput"], *block["children"]]]
                block.update(children=[], caput=unit, summary=summary or block["summary"])
            else:
                private = 0
                block = {"number": number, "adt": adt, "law": law, "caput": unit, "children": [], "versions": [], "summary": summary, "seq": seq}
                blocks.append(block)
            context, _ = ["", "", "", ""], seen.add("art" + number)
        elif block:
            s = suffix(kind, text)
            level = {"PARAGRAFO_UNICO": 0, "PARAGRAFO_NUM": 0, "INCISO": 1, "ALINEA": 2, "SUB_ALINEA": 3}.get(kind)
            if level is not None:
                context[level:] = [s] + [""] * (3 - level)
            base = "art" + block["number"] + ("" if kind == "OTHER" else "".join(context) + (s if kind == "ITEM_NUM" else ""))
            uid, k = base, 2
            while uid in seen:
                uid, k = f"{base}_{k}", k + 1
            seen.add(uid)
            block["children"].append({"seq": seq, "uid": uid, "old": row["struck"], "identifier": row["identifier"], "notes": numbered(row)})
    for b in blocks:
        for a, c in zip(b["children"], b["children"][1:]):
            a["old"] = a["old"] or a["identifier"] == c["identifier"]
    return heads, blocks
