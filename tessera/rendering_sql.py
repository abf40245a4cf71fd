"""The SQL of the renderings in JSON and Unity's formats, on the relations that a document is made of.

`doc` names, as common table expressions: sp (sprites with pivots px, py and content sizes cw, ch),
mk (markers), anim (animations with lists of frames and names) and size (aw, ah of each job's atlas).
"""

from __future__ import annotations

#: FNV-1a of a text, as an unsigned number of 64 bits.
FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, [ascii(c)::UHUGEINT FOR c IN string_split({}, '')]), lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
BOX = """'{"h":', h, ',"w":', w, ',"x":', x, ',"y":', y, '}'"""
TRIM = """'{"bottom":', trim_bottom, ',"left":', trim_left, ',"right":', trim_right, ',"top":', trim_top, '}'"""
#: Every sprite with the numbers that renderings derive: source size and pivots as shares of it.
SHARES = """shown AS (
  SELECT *, px / sw AS nx, py / sh AS ny, 1 - py / sh AS up
  FROM (SELECT *, cw + trim_left + trim_right AS sw, ch + trim_top + trim_bottom AS sh FROM sp)
)"""


def short(value: str) -> str:
    """At most eight decimals, without trailing zeros."""
    return f"regexp_replace(regexp_replace(format('{{:.8f}}', {value}), '0+$', ''), '[.]$', '')"


def frame(pivot_y: str) -> str:
    """The fields of a frame in the order of their names."""
    return f"""'"frame":', {BOX}, ',"pivot":{{"x":', nx, ',"y":', {pivot_y}, '}},"rotated":', rotated, ',"sourceSize":{{"h":', sh, ',"w":', sw,
      '}},"spriteSourceSize":{{"h":', ch, ',"w":', cw, ',"x":', trim_left, ',"y":', trim_top, '}},"trimmed":', has_trim, '}}'"""


def meta(more: str = "") -> str:
    return f"""'"meta":{{"format":"RGBA8888","image":"atlas_0.png","scale":"1","size":{{"h":', ah, ',"w":', aw, '}}{more}}}}}'"""


def by_name(doc: str, pivot_y: str, more: str = "") -> str:
    return f"""WITH {doc}, {SHARES}, b AS (
  SELECT job, string_agg(concat('"', name, '":{{', {frame(pivot_y)}), ',' ORDER BY index) AS body FROM shown GROUP BY job
)
SELECT job, concat('{{"frames":{{', body, '}},', {meta(more)}) AS content FROM b JOIN size USING (job)"""


def renderings(doc: str) -> dict[str, str]:
    marker = """'{"index":', index, ',"name":"', name, '","type":"', type, '","x":', x, ',"y":', y, CASE WHEN radius IS NOT NULL THEN concat(',"radius":', radius) ELSE '' END,
      ',"sprite_index":', sprite_index, ',"sprite_name":"', sname, '","sprite_path":"', spath, '"}'"""
    return {
        "json": f"""WITH {doc}, m AS (
  SELECT job, sprite_index AS index, string_agg(concat({marker}), ',' ORDER BY mk.index, name, type, x, y) AS marks FROM mk WHERE sprite_index IS NOT NULL GROUP BY ALL
), b AS (
  SELECT job, string_agg(concat('{{"atlas_index":', atlas_index, ',"markers":[', coalesce(marks, ''), '],"name":"', name, '","path":"', path, '","pivot":{{"x":', px, ',"y":', py,
      '}},"rect":', {BOX}, ',"rotation":', turn, ',"trim":', {TRIM}, '}}'), ',' ORDER BY index) AS body
  FROM sp LEFT JOIN m USING (job, index) GROUP BY job
), a AS (
  SELECT job, string_agg(concat('{{"fps":8,"name":"', name, '","sprite_indexes":[', array_to_string(frames, ','), '],"sprite_names":["', array_to_string(names, '","'), '"]}}'), ',' ORDER BY index) AS moving
  FROM anim GROUP BY job
)
SELECT job, concat('{{', CASE WHEN moving IS NULL THEN '' ELSE concat('"animations":[', moving, '],') END, '"atlases":[{{"height":', ah, ',"path":"atlas_0.png","width":', aw,
  '}}],"extrude":0,"multipack":false,"scale":1.0,"sprites":[', body, ']}}') AS content
FROM b JOIN size USING (job) LEFT JOIN a USING (job)""",
        "godot": f"""WITH {doc}, {SHARES}, b AS (
  SELECT job, string_agg(concat('{{"margin":', {TRIM}, ',"name":"', name, '","pivot_offset":{{"x":', nx, ',"y":', ny, '}},"region":', {BOX}, ',"rotated":', rotated,
      ',"source_size":{{"h":', sh, ',"w":', sw, '}}}}'), ',' ORDER BY index) AS body
  FROM shown GROUP BY job
), a AS (
  SELECT job, string_agg(concat('{{"from":', frames[1], ',"loop":true,"name":"', name, '","speed":8,"to":', frames[-1], '}}'), ',' ORDER BY index) AS moving FROM anim GROUP BY job
)
SELECT job, concat('{{', CASE WHEN moving IS NULL THEN '' ELSE concat('"animations":[', moving, '],') END, '"frames":[', body, '],"image":"atlas_0.png","scale":1.0,"size":{{"h":', ah, ',"w":', aw, '}}}}') AS content
FROM b JOIN size USING (job) LEFT JOIN a USING (job)""",
        "phaser-hash": by_name(doc, "ny"),
        "phaser-array": f"""WITH {doc}, {SHARES}, b AS (
  SELECT job, string_agg(concat('{{"filename":"', name, '",', {frame("ny")}), ',' ORDER BY index) AS body FROM shown GROUP BY job
)
SELECT job, concat('{{"frames":[', body, '],', {meta()}) AS content FROM b JOIN size USING (job)""",
        "unity.json": by_name(doc, "up", ',"version":"1.0"'),
    }


def unity_meta(doc: str, fixed: str) -> str:
    """fixed: the import settings, as they stand in the file."""
    return f"""WITH {doc}, {SHARES}, hashed AS (
  SELECT *, {FNV.format("name")} AS hash FROM shown
), b AS (
  SELECT job, string_agg(concat('    - first:\n        213: ', hash, '\n      second: ', name, '\n'), '' ORDER BY index) AS entries,
    string_agg(concat('    - serializedVersion: 2\n      name: ', name, '\n      rect:\n        serializedVersion: 2\n        x: ', x, '\n        y: ', ah - y - h, '\n        width: ', cw,
      '\n        height: ', ch, '\n      alignment: 9\n      pivot: {{x: ', {short("nx")}, ', y: ', {short("up")}, '}}\n      border: {{x: 0, y: 0, z: 0, w: 0}}\n      spriteID: ',
      lower(lpad(hex(hash), 16, '0')), '\n      internalID: ', hash, '\n'), '' ORDER BY index) AS rects
  FROM hashed JOIN size USING (job) GROUP BY job
)
SELECT job, concat('fileFormatVersion: 2\nguid: ', lower(lpad(hex({FNV.format("'atlas_%d.png'")}), 16, '0')), '0000000000000000\nTextureImporter:\n  internalIDToNameTable:\n', entries,
  '  externalObjects: {{}}\n  serializedVersion: 13\n{fixed}  spriteSheet:\n    serializedVersion: 2\n    sprites:\n', rects) AS content
FROM b"""


def unity_anim(doc: str) -> str:
    return f"""WITH {doc}, frames AS (
  SELECT job, index, name, len(frames) AS n, unnest(names) AS frame, generate_subscripts(names, 1) - 1 AS pos FROM anim
), keys AS (
  SELECT job, index, name, n, string_agg(concat('    - time: ', {short("pos / 8")}, '\n      value: {{fileID: ', {FNV.format("frame")}, ', guid: ',
      lower(lpad(hex({FNV.format("'atlas_%d.png'")}), 16, '0')), '0000000000000000, type: 3}}\n'), '' ORDER BY pos) AS body
  FROM frames GROUP BY ALL
)
SELECT job, concat(name, '.anim') AS name, concat('%YAML 1.1\n%TAG !u! tag:unity3d.com,2011:\n--- !u!74 &740000', index, '\nAnimationClip:\n  m_Name: ', name,
  '\n  serializedVersion: 6\n  m_Legacy: 0\n  m_PPtrCurves:\n  - curve:\n', body, '    attribute: m_Sprite\n    path:\n    classID: 212\n    script: {{fileID: 0}}\n  m_AnimationClipSettings:\n    serializedVersion: 2\n    m_StartTime: 0\n    m_StopTime: ',
  {short("n / 8")}, '\n    m_LoopTime: 1\n  m_Events: []\n') AS content
FROM keys"""
