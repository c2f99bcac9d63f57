"""The registered queries as plain SQL over the same tables, for DuckDB.

Independent statements of the results: none of them is used by a Spark job.
"""

from __future__ import annotations

from docsnap.functions.content import WHITE_SPACE
from docsnap.plans.catalog import ALPHABETS, BULK_SIZE, BYTE_SIZE
from docsnap.plans.derived import RAW_TEXTS

FILES = """files as (
  select doc_id, concat('/data/', source, '/', lang, '/doc_', cast(doc_id as varchar),
      case doc_id % 5 when 0 then '.txt' when 1 then '.pdf' when 2 then '.MD'
                      when 3 then '.tmp' else '' end) as path,
    concat('doc_', cast(doc_id as varchar),
      case doc_id % 5 when 0 then '.txt' when 1 then '.pdf' when 2 then '.MD'
                      when 3 then '.tmp' else '' end) as name,
    cast(strlen(text) as bigint) as length, 1700000000 + doc_id * 37 as mtime, text,
    concat('/data/', source, '/', lang) as directory, source, lang
  from documents)"""

PREV = """prev as (
  select path, mtime - case when doc_id % 7 = 0 then 5 else 0 end as mtime
  from files where doc_id % 10 <> 3
  union all
  select concat(path, '.gone') as path, mtime from files where doc_id % 10 = 7)"""

FEED = """feed as (
  select coalesce(f.path, p.path) as path,
    case when f.path is null then 'deleted' when p.path is null then 'new'
         when f.mtime <> p.mtime then 'modified' else 'unchanged' end as status,
    f.mtime as mtime, p.mtime as previous_mtime, f.doc_id as doc_id
  from files f full outer join prev p on f.path = p.path)"""

# Which raw keys make up a field, strongest first; the texts of the keys are input.
FIELDS = {
    "author": ["meta:author", "Author", "dc:creator"],
    "date": ["Last-Save-Date", "meta:last-modified", "Last-Modified", "dcterms:modified", "dc:date"],
    "keywords": ["meta:keyword", "Keywords"],
    "title": ["title", "dc:title"],
    "language": ["Content-Language", "dc:language"],
    "format": ["dc:format"],
    "identifier": ["dc:identifier"],
    "contributor": ["dc:contributor"],
    "coverage": ["dc:coverage"],
    "modifier": ["meta:last-author"],
    "creator_tool": ["xmp:CreatorTool"],
    "publisher": ["dc:publisher"],
    "relation": ["dc:relation"],
    "rights": ["dc:rights"],
    "source": ["dc:source"],
    "type": ["dc:type"],
    "description": ["dc:description"],
    "created": ["dcterms:created", "created", "Creation-Date"],
    "print_date": ["meta:print-date", "Print-Date"],
    "metadata_date": ["xmp:MetadataDate"],
    "latitude": ["geo:lat"],
    "longitude": ["geo:long"],
    "altitude": ["geo:alt"],
    "rating": ["xmpMM:Rating"],
    "comments": ["usercomment"],
}

_FIELDS = ",\n    ".join(
    f"coalesce({', '.join(RAW_TEXTS[k] for k in keys)}) as {name}" for name, keys in FIELDS.items()
)
RAW = f"""raw as (
  select doc_id, lang,
    {_FIELDS},
    case doc_id % 3 when 0 then 'text/html' when 1 then 'application/pdf'
                    else 'application/octet-stream' end as content_type
  from documents)"""

EVENTS = """fs_events as (
  select event_id, ts,
    case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'modified' end as kind,
    concat('/data/u', cast(user_id as varchar),
      case event_id % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp' else '' end) as src_path,
    event_id % 9 = 0 as is_directory
  from events),
pauses as (
  select min(ts) as start_ts, min(ts) + interval 20 minutes as end_ts
  from events group by user_id),
accepted as (
  select *, case when kind = 'deleted' then 'delete' else 'index' end as op
  from fs_events where not is_directory and (kind = 'deleted' or src_path not like '%.tmp')),
unpaused as (
  select e.* from accepted e where not exists (
    select 1 from pauses p where p.start_ts <= e.ts and e.ts < p.end_ts)),
latest as (
  select src_path as path, arg_max(event_id, row(ts, event_id)) as event_id,
    arg_max(op, row(ts, event_id)) as op
  from unpaused group by src_path)"""

UPLOADS = """uploads as (
  select doc_id as upload_id, concat('up_', cast(doc_id % 400 as varchar), '.txt') as filename,
    coalesce(case when doc_id % 4 = 0 then concat('id-', cast(doc_id as varchar)) end,
             concat('up_', cast(doc_id % 400 as varchar), '.txt')) as _id,
    case when doc_id % 6 = 0 then 'other_docs' else 'job_docs' end as _index,
    doc_id % 10 = 0 as simulate, doc_id % 14 = 0 as debug, text
  from documents)"""

FOLDERS = """folders as (
  select distinct unnest(['/data', concat('/data/', source), directory]) as path from files)"""

_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"


def _content(text: str) -> str:
    return f"trim({text}, {_WS})"


# What three passes make of each file: its status in the second, whether it failed there, and its
# text after the first and after the last.
PASSES = f"""passed as (
  select c.path, c.status, c.mtime, c.previous_mtime, c.status in ('new', 'modified') and c.doc_id % 13 = 0 as failed,
    case when c.status <> 'new' then coalesce({_content('f.text')}, 'gone') end as first,
    case when c.status = 'deleted' then 'gone' else {_content('f.text')} end as content
  from feed c left join files f on c.path = f.path where c.path not like '%.tmp')"""

# Files written from the documents, and the directories above them.
TREE = """tree as (
  select doc_id, source, lang, text, cast(strlen(text) as bigint) as length,
    concat(source, '/', lang, '/', case doc_id % 6 when 0 then '_' when 3 then '.' else '' end, 'doc_', cast(doc_id as varchar),
      case doc_id % 5 when 3 then '.tmp' when 4 then '.html' else '.txt' end) as path
  from documents),
tree_folders as (
  select distinct unnest(['', source, concat(source, '/', lang), concat(source, '/', lang, '/none')]) as path from tree)"""

LOG = f"""log as (
  select 1 as run_id, 1 as phase, string_split(path, '/') as ord, 'index' as op,
    'job_docs' as _index, path as _id, path, concat('v1 ', path) as content,
    cast(strlen(path) as bigint) as filesize, true as is_doc
  from prev
  union all
  select 2, 0, string_split(path, '/'), 'index', 'job_folder', path, path, null, null, false
  from folders
  union all
  select 2, 1, string_split(f.path, '/'), case when f.doc_id % 13 = 0 then 'error' else 'index' end,
    'job_docs', case when f.doc_id % 13 = 0 then null else f.path end, f.path,
    {_content('f.text')}, f.length, true
  from feed c join files f on c.path = f.path where c.status in ('new', 'modified')
  union all
  select 2, 2, string_split(path, '/'), 'delete', 'job_docs', path, path, null, null, true
  from feed where status = 'deleted'
  union all
  select 3, 1, [lpad(cast(upload_id as varchar), 20, '0')], 'index', _index, _id, filename,
    {_content('text')}, cast(strlen(text) as bigint), true
  from uploads where not simulate)"""

STATE = """state as (
  select * from (
    select *, row_number() over (partition by _index, _id order by run_id desc, phase desc, ord desc) as n
    from log where op <> 'error')
  where n = 1 and op = 'index')"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _optional(*pairs: tuple[str, str]) -> str:
    """The JSON members that follow a first one; absent where the value is null."""
    return " || ".join(f"""coalesce(',"{k}":' || cast(to_json({v}) as varchar), '')""" for k, v in pairs)


def _virtual(root: str) -> str:
    return (
        f"case when starts_with(path, '{root}/') then substr(path, {len(root) + 1}) "
        "else concat('/', name) end"
    )


_INCLUDED = "regexp_full_match(name, '.*\\.txt|doc_1.*|.*[2-4]\\.MD')"
_EXCLUDED = "regexp_full_match(name, '.*\\.tmp|doc_.5.*')"
_ISO = "strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


def _unescaped(html: str) -> str:
    """The references that the pages hold; a bare ampersand comes last and once."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        html = f"replace({html}, '{entity}', '{char}')"
    return f"regexp_replace({html}, '&amp;?', '&', 'g')"


_META = [(k, f"r.{k}") for k in FIELDS]

_DURATION = """concat(' ', cast(n_chars % 90 as varchar), case when n_chars % 3 = 0 then '.5' else '' end)"""
_SIZE = """concat(cast(n_chars % 90 as varchar), case when n_chars % 3 = 0 then '.7' else '' end)"""

ORACLES = {
    "include_filter": _with(FILES) + f"select path from files where {_INCLUDED}",
    "exclude_filter": _with(FILES) + f"select path from files where not {_EXCLUDED}",
    "size_guard": _with(FILES) + "select path, length from files where length <= 5000",
    "eligible_files": _with(FILES)
    + f"select path, length from files where {_INCLUDED} and not {_EXCLUDED} and length <= 20000",
    "pause_filter": _with(EVENTS)
    + """select event_id, src_path from fs_events e where not exists (
      select 1 from pauses p where p.start_ts <= e.ts and e.ts < p.end_ts)""",
    "pauses_of_years": _with(EVENTS)
    + """, moved as (
        select event_id, case when event_id % 3 = 0 then timestamp '2024-01-10 00:00:00' + to_seconds(case when event_id % 2 = 0 then 0 else event_id % 86400 end)
          else ts end as ts from fs_events),
      either as (
        select start_ts, end_ts from pauses
        union all select start_ts - interval 30 years, start_ts - interval 20 days from pauses)
      select event_id, epoch_us(ts) as ts_us from moved e where not exists (
        select 1 from either p where p.start_ts <= e.ts and e.ts < p.end_ts)""",
    "change_feed": _with(FILES, PREV, FEED) + "select path, status, mtime, previous_mtime from feed",
    "change_feed_by_digest": _with(FILES, PREV, FEED)
    + "select path, status, cast(mtime as double) as mtime, cast(previous_mtime as double) as previous_mtime from feed",
    "new_or_modified": _with(FILES, PREV)
    + """select f.path, f.mtime from files f left join prev p on f.path = p.path
      where p.mtime is null or p.mtime <> f.mtime""",
    "deleted_files": _with(FILES, PREV)
    + """select path from prev where path not in (select path from files where path not like '%.tmp')""",
    "next_snapshot_rows": _with(FILES, PREV, FEED)
    + """select path, case when failed then previous_mtime else mtime end as mtime
      from (select *, status in ('new', 'modified') and doc_id % 11 = 0 as failed from feed
            where status <> 'deleted')
      where not failed or previous_mtime is not null""",
    "file_info": _with(FILES)
    + f"""select doc_id, name as filename,
      case doc_id % 5 when 0 then 'txt' when 1 then 'pdf' when 2 then 'md' when 3 then 'tmp' else '' end
        as extension,
      length as filesize, cast(length(text) as bigint) as indexed_chars, {_ISO} as last_modified,
      path as url from files""",
    "path_info": _with(FILES)
    + f"""select doc_id, path as real, {_virtual('/data')} as virtual,
      {_virtual('/data/src1')} as virtual_in_part from files""",
    "folder_docs": _with(FILES, FOLDERS)
    + """select path as _id, path as real, '/data' as root,
      case when path = '/data' then '/' else substr(path, 6) end as virtual from folders""",
    "content_type": _with(RAW) + "select doc_id, content_type from raw",
    "content_truncate": f"""with whole as (
      select doc_id, trim(concat(' ', chr(10), ' ', chr(9), text, chr(10), 'tail  ', chr(10)), {_WS}) as t
      from documents)
    select doc_id, substr(t, 1, 200) as content, cast(length(substr(t, 1, 200)) as bigint) as indexed_chars,
      md5(t) as whole_md5 from whole""",
    "checksum": """select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256,
      cast(null as varchar) as unknown from documents""",
    "doc_id_path": _with(FILES) + "select doc_id, path as _id from files",
    "doc_id_path_hash": _with(FILES) + "select doc_id, sha256(path) as _id from files",
    "doc_id_content_hash": _with(FILES)
    + f"""select sha256(text) as _id, arg_max(path, string_split(path, '/')) as path,
      md5(any_value({_content('text')})) as content_md5 from files group by 1""",
    "metadata_map": _with(RAW)
    + f"select doc_id, {', '.join(FIELDS)} from raw",
    "typed_meta": _with(RAW)
    + """select doc_id,
      case date when '2023-05-06T07:08:09Z' then epoch_us(timestamp '2023-05-06 07:08:09')
                when '2024-01-01T00:00:00Z' then epoch_us(timestamp '2024-01-01 00:00:00')
                when '2022-03-04T05:06:07Z' then epoch_us(timestamp '2022-03-04 05:06:07')
                when '2022-07' then epoch_us(timestamp '2022-07-01 00:00:00') end as date_us,
      cast(try_cast(rating as smallint) as bigint) as rating,
      concat_ws(',', case when date in ('not a date', 'yesterday') then 'date' end,
                     case when rating = 'high' then 'rating' end) as rejected
    from raw""",
    "attachment_b64": "select doc_id, base64(encode(text)) as attachment from documents",
    "doc_json": _with(FILES, RAW)
    + f"""select f.doc_id, '{{"file":{{"content_type":' || to_json(content_type)
      || {_optional(
          ("filename", "name"),
          ("extension", "case f.doc_id % 5 when 0 then 'txt' when 1 then 'pdf' when 2 then 'md' when 3 then 'tmp' else '' end"),
          ("filesize", "length"),
          ("indexed_chars", f"length({_content('text')})"),
          ("indexing_date", "'2024-02-01T00:00:00+00:00'"),
          ("last_modified", _ISO),
          ("checksum", "sha1(text)"),
          ("url", "path"),
      )}
      || '}},"path":{{"real":' || to_json(path) || {_optional(("root", "'/data'"), ("virtual", _virtual('/data')))}
      || '}}' || ',"meta":{{' || substr({_optional(*_META)}, 2) || '}}'
      || {_optional(("content", _content("text")), ("attachment", "base64(encode(text))"))} || '}}' as json
    from files f join raw r on f.doc_id = r.doc_id""",
    "parse_duration": f"""select doc_id, cast({_DURATION} as double) * case n_chars % 7
        when 0 then 0.001e0 when 1 then 1e0 when 2 then 60e0 when 3 then 3600e0 when 4 then 86400e0
        when 5 then 1e0 end as seconds from documents""",
    "parse_byte_size": f"""select doc_id, cast(trunc(cast({_SIZE} as double) * case n_chars % 7
        when 0 then 1e0 when 1 then 1024e0 when 2 then 1048576e0 when 3 then 1073741824e0
        when 4 then 1099511627776e0 when 5 then 1e0 end) as bigint) as bytes from documents""",
    "parse_indexed_chars": """select doc_id, case when n_chars % 3 < 2 then
        case when n_chars % 4 = 0 then -n_chars else n_chars end end as chars from documents""",
    "html_title_lang": f"""select page_id,
      nullif(trim(regexp_replace({_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")},
        '[\\s\\x{{00A0}}]+', ' ', 'g')), '') as title,
      nullif(regexp_extract(html, '(?is)<html[^>]*?\\slang\\s*=\\s*["'']?([a-z0-9-]+)', 1), '') as lang
    from pages""",
    "html_text": f"""select page_id, trim(regexp_replace({_unescaped(
        "regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)', ' ', 'g'), '<[^>]*>', ' ', 'g')"
      )}, '[\\s\\x{{00A0}}]+', ' ', 'g')) as text from pages""",
    "upload_docs": _with(UPLOADS)
    + f"""select upload_id, _index, _id, concat('/', _index, '/_doc/', _id) as url,
      'text/plain' as content_type, 'txt' as extension, cast(strlen(text) as bigint) as filesize,
      concat('/', filename) as virtual, md5({_content('text')}) as content_md5,
      case when debug then md5('{{"file":{{"content_type":"text/plain"' || {_optional(
          ("filename", "filename"), ("extension", "'txt'"), ("filesize", "strlen(text)"),
          ("indexed_chars", f"length({_content('text')})"),
          ("indexing_date", "'2024-02-01T00:00:00+00:00'"),
          ("last_modified", "'2024-02-01T00:00:00+00:00'"), ("url", "''"),
      )} || '}},"path":{{"real":' || to_json(filename) || {_optional(
          ("root", "'/data'"), ("virtual", "concat('/', filename)"))}
        || '}}' || {_optional(("content", _content('text')))} || '}}') end as shown_md5,
      not simulate as written
    from uploads""",
    "upload_state": _with(UPLOADS)
    + f"""select _index, _id, md5({_content('arg_max(text, upload_id)')}) as content_md5
      from uploads where not simulate group by _index, _id""",
    "delete_requests": _with(UPLOADS)
    + "select distinct 'delete' as op, _index, _id from uploads",
    "delete_ops": _with(FILES, PREV)
    + """select 'delete' as op, 'job_docs' as _index, sha256(path) as _id, path from prev
      where path not in (select path from files where path not like '%.tmp')""",
    "current_state": _with(FILES, PREV, FEED, FOLDERS, UPLOADS, LOG, STATE)
    + "select _index, _id, cast(run_id as bigint) as run_id, md5(content) as content_md5 from state",
    "index_counts": _with(FILES, PREV, FEED, FOLDERS, UPLOADS, LOG, STATE)
    + "select _index, count(*) as documents from state group by _index",
    "run_summary": _with(FILES, PREV, FEED, FOLDERS, UPLOADS, LOG)
    + """select cast(run_id as bigint) as run_id, _index, op, count(*) as operations
      from log group by 1, 2, 3""",
    "alias_union": _with(FILES, PREV, FEED, FOLDERS, UPLOADS, LOG, STATE)
    + """select _index, _id,
      case when run_id = 3 then concat('/', path) when path = '/data' then '/'
           else substr(path, 6) end as virtual,
      filesize from state""",
    "scan_order": _with(FILES)
    + """select path, row_number() over (order by string_split(path, '/')) - 1 as position from files""",
    "bulk_batches_by_size": _with(
        FILES,
        f"""ranked as (
      select path, length as bytes,
        row_number() over (order by string_split(path, '/')) - 1 as position from files)""",
        f"""walk as (
      select path, position, 0 as batch, 1 as n, bytes as total from ranked where position = 0
      union all
      select s.path, s.position,
        case when w.n >= {BULK_SIZE} or w.total >= {BYTE_SIZE} then w.batch + 1 else w.batch end,
        case when w.n >= {BULK_SIZE} or w.total >= {BYTE_SIZE} then 1 else w.n + 1 end,
        case when w.n >= {BULK_SIZE} or w.total >= {BYTE_SIZE} then s.bytes else w.total + s.bytes end
      from walk w join ranked s on s.position = w.position + 1)""",
        recursive=True,
    )
    + "select path, cast(batch as bigint) as batch from walk",
    "bulk_lines": _with(FILES, PREV, FEED, FOLDERS, UPLOADS, LOG, """lines as (
      select l.*, f.name, f.mtime, f.doc_id, unnest(case when op = 'index' then [0, 1] else [0] end) as pos
      from log l left join files f on f.path = l.path where run_id = 2 and phase <> 0 and op <> 'error')""")
    + f"""select path, phase, pos, case when pos = 0 then
        '{{"' || op || '":{{"_index":' || to_json(_index) || ',"_id":' || to_json(_id) || '}}}}'
      else '{{"file":{{"content_type":"application/octet-stream"' || {_optional(
          ("filename", "name"),
          ("extension", "case doc_id % 5 when 0 then 'txt' when 1 then 'pdf' when 2 then 'md' when 3 then 'tmp' else '' end"),
          ("filesize", "filesize"),
          ("indexed_chars", "length(content)"),
          ("indexing_date", "'2024-02-01T00:00:00+00:00'"),
          ("last_modified", _ISO),
          ("url", "path"),
      )} || '}},"path":{{"real":' || to_json(path) || {_optional(("root", "'/data'"), ("virtual", _virtual('/data')))}
        || '}}' || {_optional(("content", "content"))} || '}}' end as line
      from lines""",
    "path_tree_counts": _with(FILES)
    + """select node, count(*) as files from (
        select unnest(list_transform(range(2, len(string_split(path, '/')) + 1),
          lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as node from files)
      group by node""",
    "kept_path_counts": _with(FILES)
    + """select node as key, count(*) as count from (
        select unnest(list_transform(range(2, len(string_split(path, '/')) + 1),
          lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as node from files where doc_id % 4 <> 1)
      group by node union all select 'job_docs', count(*) from files where doc_id % 4 <> 1""",
    "operations_stream": _with(FILES, PREV, FEED, PASSES)
    + """select 1 as run_id, 'index' as op, path, md5(first) as content_md5 from passed where first is not null
      union all select 2, case when status = 'deleted' then 'delete' when failed then 'error' else 'index' end, path,
        case when status <> 'deleted' and not failed then md5(content) end
      from passed where status <> 'unchanged'
      union all select 4, 'index', path, md5(content) from passed where failed""",
    "term_postings": """select term, doc_id, count(*) as tf from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents)
      group by term, doc_id""",
    "term_document_frequency": """select term, count(distinct doc_id) as df from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents)
      group by term""",
    "event_ops": _with(EVENTS) + "select event_id, op, src_path as _id from accepted",
    "event_latest": _with(EVENTS) + "select path, event_id, op from latest",
    "crawl_two_runs": _with(FILES, PREV, FEED, PASSES)
    + """select 'job_docs' as _index, path as _id, md5(content) as content_md5 from passed where status <> 'deleted'""",
    "crawl_keeps_deleted": _with(FILES, PREV, FEED, PASSES)
    + "select 'job_docs' as _index, path as _id, md5(content) as content_md5 from passed",
    "crawl_snapshot": _with(FILES, PREV, FEED, PASSES)
    + """select path, cast(case when failed then previous_mtime else mtime end as double) as mtime from passed
      where status <> 'deleted' and not (failed and previous_mtime is null)""",
    "crawl_errors": _with(FILES, PREV, FEED, PASSES)
    + "select cast(2 as bigint) as run_id, path, 'unreadable' as error from passed where failed",
    "crawl_folders": _with(FILES, PREV, FOLDERS)
    + """select 'job_folder' as _index, path as _id, case when path = '/data' then '/' else substr(path, 6) end as virtual
      from folders where exists (select 1 from prev p where starts_with(p.path, folders.path || '/'))""",
    "crawl_then_events": _with(EVENTS, FILES, PREV, FEED, PASSES)
    + """select 'job_docs' as _index, path as _id, md5(first) as content_md5 from passed where first is not null
      union all
      select 'job_docs', path, md5(concat('content of ', path)) from latest where op = 'index'""",
    "event_stream_state": _with(EVENTS)
    + """select 'job_docs' as _index, path as _id, concat('content of ', path) as content
      from latest where op = 'index'""",
    "tree_listing": _with(TREE)
    + """select path, false as is_dir, length from tree
      union all select path, true, null from tree_folders""",
    "tree_names": _with(TREE)
    + r"""select path, length from tree
      where not regexp_matches(path, '(\.tmp|/doc_.5[^/]*)$')""",
    "tree_links": _with(TREE)
    + """select false as link, count(*) as files from tree
      union all select true, count(distinct (source, lang)) from tree""",
    "tree_without_links": _with(TREE)
    + """select path, false as is_dir, false as is_symlink from tree
      union all select path, true, false from tree_folders""",
    "vanished_files": _with(TREE) + "select path, length from tree where path not like '%.tmp'",
    "read_files": _with(TREE)
    + """select path, case when path not like '%.tmp' then md5(text) end as md5,
        case when path like '%.tmp' then 'FileNotFoundError' end as error from tree""",
    "python_extractor": f"""select doc_id,
        case when length(text) % 7 = 0 then concat('ValueError: ', cast(length(text) as varchar)) end as error,
        case when length(text) % 7 > 0 then left(text, 20) end as title,
        case when length(text) % 7 > 0 then substr(text, 21, 5) end as keywords,
        case when length(text) % 7 > 0 then md5({_content("concat(left(text, 50), chr(10), substr(text, 51, 30))")}) end as content_md5
      from documents""",
    "found_encodings": "with turned as (select doc_id, regexp_replace(case doc_id % 8 "
    + " ".join(f"when {n} then translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{a}')" for n, a in enumerate(ALPHABETS.values()))
    + r""" end, '[\x{7f}-\x{2ff}\x{2000}-\x{2fff}]', '', 'g') as text from documents)
      select doc_id, length(text) as n_chars, md5(text) as text_md5 from turned where length(text) >= 40""",
    "snapshot_import": _with(FILES, PREV) + "select path, cast(mtime as double) as mtime from prev",
    "crawl_tree": _with(TREE)
    + f"""select 'job_docs' as _index, concat('/', path) as virtual, length as filesize, md5({_content('text')}) as content_md5
      from tree where path like '%.txt'
      union all select 'job_folder', concat('/', path), null, null from tree_folders""",
    "bootstrap_then_stream": _with(FILES)
    + f""", late as (
        select event_id, user_id, case event_type when 'error' then 'delete' else 'index' end as op,
          concat('/data/u', cast(user_id as varchar),
            case event_id % 4 when 0 then '.pdf' when 1 then '.txt' when 2 then '.tmp' else '' end) as path,
          ts + interval 900 years as ts
        from events where event_id % 2 = 0 and event_id % 9 > 0),
      last as (
        select * from late where op = 'delete' or path not like '%.tmp'
        qualify row_number() over (partition by path order by ts desc, event_id desc) = 1)
      select 'job_docs' as _index, path as _id, md5({_content('text')}) as content_md5 from files where path not like '%.tmp'
      union all select 'job_docs', path, md5(concat('content of ', path)) from last where op = 'index' and user_id % 5 > 0""",
    "periodic_passes": _with(FILES)
    + f"""select 'job_docs' as _index, path as _id, md5({_content('text')}) as content_md5 from files
      where path not like '%.tmp' and doc_id % 13 > 0""",
    "stream_errors": _with(EVENTS)
    + """, found as (select path, cast(regexp_extract(path, 'u([0-9]+)', 1) as bigint) % 5 = 0 as failed from latest where op = 'index')
      select path, case when failed then 'unreadable' else '' end as error from found""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
