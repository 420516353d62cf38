"""Display functions: ages, durations, colours, initials, excerpts, labels, types, stamps; address classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, empty

# The palette, and what ages are called.
PALETTE = ("#1F2937", "#374151", "#4B5563", "#0E9F6E", "#2563EB", "#7C3AED", "#C2410C", "#BE185D", "#0369A1", "#B45309")
JUST_NOW, YESTERDAY, NEVER = "刚刚", "昨天", "—"
AGES = (("分钟前", 60, 3600), ("小时前", 3600, 86_400))
OLDER = (("天前", 86_400, 30 * 86_400), ("个月前", 30 * 86_400, 365 * 86_400), ("年前", 365 * 86_400, None))


def time_ago(ts: Column, as_of: Column) -> Column:
    """How long before ``as_of`` something was, in the largest whole unit."""
    s = (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6

    def units(name: str, size: int) -> Column:
        return F.concat(F.floor(s / size).cast("long"), F.lit(f" {name}"))

    out = F.when(ts.isNull(), NEVER).when(s < 60, JUST_NOW)
    for name, size, limit in AGES:
        out = out.when(s < limit, units(name, size))
    out = out.when(s < 2 * 86_400, YESTERDAY)
    for name, size, limit in OLDER[:-1]:
        out = out.when(s < limit, units(name, size))
    return out.otherwise(units(*OLDER[-1][:2]))


def duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("long"), F.lit(" ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))
        .otherwise(
            F.concat(
                F.floor(ms / 60_000).cast("long"), F.lit(" 分 "), F.floor(ms % 60_000 / 1000 + 0.5).cast("long"), F.lit(" 秒")
            )
        )
    )


def color(seed: Column) -> Column:
    """A palette colour by a 31-polynomial hash of the text, modulo 2^32."""
    h = F.aggregate(
        F.transform(F.filter(F.split(empty(seed), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")),
        F.lit(0).cast("long"),
        lambda a, c: (a * 31 + c).bitwiseAND(F.lit((1 << 32) - 1)),
    )
    return F.get(F.array(*[F.lit(c) for c in PALETTE]), (h % len(PALETTE)).cast("int"))


def initials(name: Column) -> Column:
    s = F.trim(empty(name))
    parts = F.filter(F.split(s, r"[\s._-]+"), lambda p: p != "")
    two = F.upper(F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.substring(F.get(parts, F.lit(1)), 1, 1)))
    return (
        F.when(s == "", "?")
        .when(s.rlike(f"[{HAN}]"), F.right(s, F.lit(2)))
        .when(F.size(parts) >= 2, two)
        .otherwise(F.upper(F.substring(s, 1, 2)))
    )


def excerpt(text: Column, n: int = 110) -> Column:
    s = F.trim(F.regexp_replace(empty(text), r"\s+", " "))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


# Classes of IPv4 ranges (base, prefix length), the first that fits counts.
IPV4_CLASSES = (
    ("unspecified", "0.0.0.0", 32),
    ("loopback", "127.0.0.0", 8),
    ("link-local", "169.254.0.0", 16),
    ("private", "10.0.0.0", 8),
    ("private", "172.16.0.0", 12),
    ("private", "192.168.0.0", 16),
    ("shared", "100.64.0.0", 10),
    ("benchmark", "198.18.0.0", 15),
    ("multicast", "224.0.0.0", 4),
    ("reserved", "240.0.0.0", 4),
)


def ipv4_number(host: Column) -> Column:
    """An IPv4 literal as a number; null for anything else."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    fine = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(fine & ~F.exists(F.split(F.when(fine, host), r"\."), lambda p: p.cast("int") > 255), value)


def address_class(host: Column) -> Column:
    """The class of an address literal; ``public`` for other addresses, ``name`` for host names."""
    bare = F.lower(F.regexp_replace(empty(host), r"^\[|\]$", ""))
    mapped = F.regexp_extract(bare, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    v = ipv4_number(F.when(mapped != "", mapped).otherwise(bare))
    out = F.when(F.lit(False), "")
    for name, base, bits in IPV4_CLASSES:
        a, b, c, d = map(int, base.split("."))
        shift = 32 - bits
        out = out.when(F.shiftright(v, shift) == ((a << 24 | b << 16 | c << 8 | d) >> shift), name)
    first = F.conv(F.split(bare, ":")[0], 16, 10).cast("long")
    six = (
        F.when(bare.isin("::1", "0:0:0:0:0:0:0:1"), "loopback")
        .when(bare == "::", "unspecified")
        .when(first.bitwiseAND(F.lit(0xFFC0)) == 0xFE80, "link-local")
        .when(first.bitwiseAND(F.lit(0xFE00)) == 0xFC00, "private")
        .when(first.bitwiseAND(F.lit(0xFF00)) == 0xFF00, "multicast")
        .otherwise("public")
    )
    return F.when(v.isNotNull(), out.otherwise("public")).when(F.contains(bare, F.lit(":")), six).otherwise("name")


# Media types of file extensions.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
    "html": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "zip": "application/zip", "mp3": "audio/mpeg", "mp4": "video/mp4",
}
# What roles, permissions, parse states and kinds of files are called.
ROLE_LABELS = {"owner": "所有者", "admin": "管理员", "editor": "编辑者", "commenter": "评论者", "viewer": "只读", "member": "成员", "guest": "访客"}
PERMISSION_LABELS = {"manage": "可管理", "edit": "可编辑", "comment": "可评论", "view": "只读", "none": "无权限", "inherit": "继承"}
STATUS_LABELS = {"ok": "已解析", "processing": "解析中", "pending": "待解析", "failed": "解析失败", "empty": "无文本"}
KIND_EXTENSIONS = {
    "pdf": "pdf", "doc": "doc docx rtf odt pages", "sheet": "xls xlsx csv tsv ods numbers", "slide": "ppt pptx key odp",
    "md": "md markdown mdx", "txt": "txt log ini conf cfg env properties",
    "code": "json xml yml yaml toml sql js mjs cjs ts tsx jsx py java c h cpp hpp cs go rs rb php swift kt sh ps1 html htm css scss less vue svelte",
    "image": "png jpg jpeg gif webp bmp svg ico avif", "media": "mp3 wav m4a flac ogg aac mp4 webm mov avi mkv",
    "zip": "zip rar 7z tar gz bz2 xz",
}
KIND_LABELS = {
    "pdf": "PDF", "doc": "DOC", "sheet": "XLS", "slide": "PPT", "md": "MD", "txt": "TXT", "code": "CODE", "image": "IMG",
    "media": "MEDIA", "zip": "ZIP",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def mime_type(ext: Column, fallback: str = "application/octet-stream") -> Column:
    """The media type of a file extension in any case."""
    return F.coalesce(_looked_up(MIME_TYPES, F.lower(empty(ext))), F.lit(fallback))


def role_label(role: Column) -> Column:
    return F.coalesce(_looked_up(ROLE_LABELS, empty(role)), F.when(role != "", role), F.lit(ROLE_LABELS["member"]))


def permission_label(permission: Column) -> Column:
    return F.coalesce(_looked_up(PERMISSION_LABELS, empty(permission)), permission)


def status_label(status: Column) -> Column:
    return F.coalesce(_looked_up(STATUS_LABELS, empty(status)), status)


def file_kind(ext: Column) -> Column:
    table = {e: kind for kind, line in KIND_EXTENSIONS.items() for e in line.split()}
    return F.coalesce(_looked_up(table, F.lower(empty(ext))), F.lit("other"))


def file_kind_label(ext: Column) -> Column:
    return F.coalesce(_looked_up(KIND_LABELS, file_kind(ext)), F.lit("FILE"))


def short_bytes(n: Column, digits: int = 1) -> Column:
    """A size as lists show it: no decimals from 10 KB to 1 MB."""
    v = F.coalesce(n.cast("double"), F.lit(0.0))
    return (
        F.when(v < 1024, F.format_string("%d B", v.cast("long")))
        .when(v < 10 * 1024, F.format_string("%.1f KB", v / 1024))
        .when(v < 1024**2, F.format_string("%.0f KB", v / 1024))
        .when(v < 1024**3, F.format_string(f"%.{digits}f MB", v / 1024**2))
        .otherwise(F.format_string("%.2f GB", v / 1024**3))
    )


def month_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def dos_stamp(ts: Column) -> Column:
    """(time, date) of a ZIP entry: two-second steps, years from 1980."""
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    year = F.greatest(F.lit(1980), F.year(ts)) - 1980
    date = F.shiftleft(year.bitwiseAND(F.lit(127)), 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    return F.struct(time.alias("time"), date.alias("date"))


def date_label(ts: Column, with_time: bool = False) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd"), F.lit(NEVER))


def sse_frame(event: Column, data: Column, id_: Column | None = None) -> Column:
    """A server-sent event: id and event lines, a data line for every line of the data, an empty line."""
    lines = F.array_join(F.transform(F.split(empty(data), "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))), "")
    head = F.when(empty(event) != "", F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise("")
    first = F.lit("") if id_ is None else F.when(id_.isNotNull(), F.concat(F.lit("id: "), id_.cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(first, head, lines, F.lit("\n"))


def merged_meta(meta: Column, added: dict[str, Column]) -> Column:
    """A JSON object with values added or replaced, as JSON."""
    old = F.coalesce(F.from_json(empty(meta), "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(old, lambda k, v: ~k.isin(list(added)))
    return F.to_json(F.map_concat(kept, new))


def office_words(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(empty(text), r"\s+"), lambda w: w != "")).cast("long")
