"""SQL for DuckDB that states the results of the pN_ queries independently, where SQL can."""

from __future__ import annotations

import unicodedata

# What the tables hold of characters that are not drawn, in DuckDB's notation.
UNDRAWN = r"\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{2065}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}\x{fff0}-\x{fff8}\x{e0100}-\x{e01ef}"
# Letters and signs of one shape in these tables. The first of each group stands for all.
ALIKE = "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟ PРΡ SЅ TТΤ XХΧ YУΥҮ ZΖ aаα cсϲ dԁ eе gɡ hһ iі jјϳ lӏ oоοօ pрρ qԛ sѕ uυ vν wԝ xх yу ĐƉÐ -‐‑ ·‧∙⋅ :∶ /∕⁄ ,‚ .․ !ǃ ’ʼ"


def _look(text: str) -> str:
    """The look of a text: width by compatibility, one kind of space, and one character of each shape."""
    one: dict[str, str] = {}
    for group in ALIKE.split():
        one.update(dict.fromkeys(group[1:], group[0]))
    several = {}
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)):
        c = chr(code)
        kind, shape = unicodedata.decomposition(c).split(" ")[0], unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            one[c] = " "
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and (0x2160 <= code < 0x2180 or 0x2E80 <= code < 0x2FE0):
            if len(shape) == 1:
                one[c] = one.get(shape, shape)
            elif len(shape) > 1:
                several[c] = shape
        elif kind and kind[0] != "<":  # letters with marks, which may stand on a letter of another script
            base, *marks = unicodedata.normalize("NFD", c)
            composed = unicodedata.normalize("NFC", one.get(base, base) + "".join(marks))
            if base in one and len(composed) == 1:
                one[c] = composed
    one["ﾞ"], one["ﾟ"] = "\u3099", "\u309a"
    one |= dict.fromkeys("\t\n\v\f\r\x85\u2028\u2029", " ")
    shown = f"regexp_replace({text}, '[{UNDRAWN}]', '', 'g')"
    for c, shape in several.items():
        shown = f"replace({shown}, '{c}', '{shape}')"
    quote = lambda x: x.replace("'", "''")
    return f"trim(nfc_normalize(translate(nfc_normalize({shown}), '{quote(''.join(one))}', '{quote(''.join(one.values()))}')), ' ')"


_RUNS = """
with kept as (
    select distinct video_id, shot_id, frame_index, keyframe_id, time_ms, ('0x' || lpad(lower(dhash), 16, '0'))::ubigint as h
    from keyframes where rejected is null and regexp_matches(dhash, '^[0-9a-fA-F]{1,16}$')
), flagged as (
    select *, case when bit_count(xor(h, lag(h) over w)) <= 6 then 0 else 1 end as fresh from kept
    window w as (partition by video_id, shot_id order by frame_index, keyframe_id)
), numbered as (
    select *, sum(fresh) over (partition by video_id, shot_id order by frame_index, keyframe_id) as run from flagged
)
select video_id, shot_id, arg_min(keyframe_id, frame_index) as first_keyframe_id, arg_max(keyframe_id, frame_index) as last_keyframe_id,
    count(*) as events, max(time_ms) - min(time_ms) as duration
from numbered group by video_id, shot_id, run
"""


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all(strip_accents(replace(replace(regexp_replace(lower(regexp_replace(text, '[{UNDRAWN}]', '', 'g')), '\\p{{Mc}}', ' ', 'g'), 'ß', 'ss'), 'đ', 'd')), '[\\p{{L}}\\p{{N}}_]+')"
    return {
        "p1_found": f"""
            with lines as (
                select distinct line_id, video_id, shot_id, lane, text, {_look('text')} as look
                from shot_lines where regexp_matches(text, '[\\p{{L}}\\p{{N}}]')
            )
            select a.line_id as line_id_a, b.line_id as line_id_b
            from lines a join lines b using (video_id, shot_id, lane, look) where a.line_id < b.line_id and a.text <> b.text
        """,
        "p1_forms": f"""
            with lines as (select distinct line_id, text, {_look('text')} as look from shot_lines)
            select line_id, case when text is not null then first_value(text) over (partition by look order by length(text), text) end as canonical from lines
        """,
        "p2_found": """
            with edges as (
                select distinct segment_id, video_id, 'start' as edge, start_ms as moment from asr union select distinct segment_id, video_id, 'end', end_ms from asr
            ), frames as (select distinct video_id, keyframe_id, time_ms from keyframes where indexed),
            ranked as (
                select segment_id, edge, keyframe_id, row_number() over (partition by segment_id, edge order by abs(time_ms - moment), time_ms, keyframe_id) as r
                from edges join frames using (video_id) where abs(time_ms - moment) <= 800
            )
            select segment_id, edge, keyframe_id from ranked where r = 1
        """,
        "p4_found": f"select video_id, first_keyframe_id, last_keyframe_id from ({_RUNS}) where events > 1",
        "p4_runs": _RUNS,
        "p5_found": """
            with hits as (select distinct query_id, video_id, hit_id, frame_index, score from shot_hits where video_id is not null and score is not null and not isnan(score))
            select query_id, video_id, hit_id from hits
            qualify row_number() over (partition by query_id, video_id order by score desc, frame_index, hit_id) <= 5
        """,
        "p7_spans": f"""
            with letters as (
                select doc_id, unnest(c) as c, unnest(range(len(c))) as i from (select doc_id, regexp_extract_all(text, '(?s).') as c from documents)
            ), folded as (
                select doc_id, i, case when regexp_matches(c, '[{UNDRAWN}\\p{{Mn}}]') then '' when regexp_matches(c, '\\p{{Mc}}') then ' ' else strip_accents(replace(replace(lower(c), 'ß', 'ss'), 'đ', 'd')) end as f
                from letters
            ), drawn as (
                select doc_id, i, f, regexp_matches(f, '^[\\p{{L}}\\p{{N}}_]+$') as inside, sum(case when regexp_matches(f, '^[\\p{{L}}\\p{{N}}_]+$') then 0 else 1 end) over (partition by doc_id order by i) as gap
                from folded where f <> ''
            ), worded as (
                select doc_id, string_agg(f, '' order by i) as word, min(i) as a, max(i) + 1 as b from drawn where inside group by doc_id, gap
            ), texts as (
                select doc_id, list(word order by a) as w, list(a order by a) as starts, list(b order by a) as ends from worded group by doc_id
            ), held as (
                select distinct item_id, list_slice(w, i, i + 11) as stretch from (select item_id, {words} as w from eval_items), unnest(range(1, len(w) - 10)) as t(i)
            ), hits as (
                select distinct doc_id, item_id, k from (select doc_id, k, list_slice(w, k, k + 11) as stretch from texts, unnest(range(1, len(w) - 10)) as t(k)) join held using (stretch)
            ), flagged as (
                select *, case when k - lag(k) over (partition by doc_id, item_id order by k) <= 12 then 0 else 1 end as fresh from hits
            ), quoted as (
                select doc_id, item_id, min(k) as first, max(k) + 11 as last from (select *, sum(fresh) over (partition by doc_id, item_id order by k) as part from flagged) group by doc_id, item_id, part
            )
            select doc_id, item_id, starts[first] as start_char, ends[last] as end_char from quoted join texts using (doc_id)
        """,
        "p7_found": f"""
            with held as (
                select item_id, list_slice(w, i, i + 11) as stretch from (select item_id, {words} as w from eval_items), unnest(range(1, len(w) - 10)) as t(i)
            ), said as (
                select doc_id, list_slice(w, i, i + 11) as stretch from (select doc_id, {words} as w from documents), unnest(range(1, len(w) - 10)) as t(i)
            )
            select distinct doc_id, item_id from said join held using (stretch)
        """,
    }
