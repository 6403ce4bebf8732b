"""The same results as SQL for another engine, derived from the tables on their own terms."""

from __future__ import annotations

from whisperlake.plans.views import DAY, EPOCH, ME, MID_SHIPPING, NOW


# The two-character escapes of a JSON string, backslash first, then the rest below 0x20.
SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
LONG_ESCAPES = [(chr(i), f"\\u{i:04x}") for i in range(0x20) if chr(i) not in {raw for raw, _ in SHORT_ESCAPES}]


def H(x) -> str:
    return f"sha256(cast(({x}) as varchar))"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def esc(x: str) -> str:
    for raw, out in [*SHORT_ESCAPES, *LONG_ESCAPES]:
        x = f"replace({x}, chr({ord(raw)}), {quote(out)})"
    return x


def _array_text(items: str) -> str:
    return f"'[' || array_to_string({items}, ',') || ']'"


def tags_text(tags: str) -> str:
    inner = _array_text(f"list_transform(t, lambda x: '\"' || {esc('x')} || '\"')")
    return f"({_array_text(f'list_transform({tags}, lambda t: {inner})')})"


def event_hash(pubkey="pubkey", created_at="created_at", kind="kind", tags="tags", content="content") -> str:
    return (
        f"sha256('[0,\"' || {pubkey} || '\",' || {created_at} || ',' || {kind} || ',' || {tags_text(tags)} "
        f"|| ',\"' || {esc(content)} || '\"]')"
    )


def event_text(sig: str = "") -> str:
    return (
        "('{\"id\":\"' || id || '\",\"pubkey\":\"' || pubkey || '\",\"created_at\":' || created_at || ',\"kind\":' || kind "
        f"|| ',\"tags\":' || {tags_text('tags')} || ',\"content\":\"' || {esc('content')} || '\"' {sig} || '}}')"
    )


def values(tags: str, name: str) -> str:
    hits = f"list_filter({tags}, lambda t: len(t) >= 2 and t[1] = '{name}')"
    return f"list_transform({hits}, lambda t: t[2])"


def part(x: str, group: int) -> str:
    """A piece of a URL, cut off by its separators one after another: scheme, user with @, host, port, path, ?query, #fragment."""
    def tail(text: str, sign: str) -> str:
        return f"case when strpos({text}, '{sign}') > 0 then substr({text}, strpos({text}, '{sign}')) else '' end"

    rest = f"(case when strpos({x}, '://') > 0 then substr({x}, strpos({x}, '://') + 3) else '' end)"
    plain = f"split_part({rest}, '#', 1)"
    place = f"split_part({plain}, '?', 1)"
    who = f"split_part({place}, '/', 1)"
    host = f"(case when strpos({who}, '@') > 0 then substr({who}, strpos({who}, '@') + 1) else {who} end)"
    return "(" + {
        1: f"case when strpos({x}, '://') > 0 then split_part({x}, '://', 1) else '' end",
        2: f"case when strpos({who}, '@') > 0 then substr({who}, 1, strpos({who}, '@')) else '' end",
        3: f"split_part({host}, ':', 1)", 4: f"split_part({host}, ':', 2)", 5: tail(place, "/"), 6: tail(plain, "?"), 7: tail(rest, "#"),
    }[group] + ")"


def web_ok(x: str, schemes: str = "'http', 'https'") -> str:
    port = part(x, 4)
    return (
        f"coalesce(lower({part(x, 1)}) in ({schemes}) and ({port} = '' or coalesce(try_cast({port} as bigint), 65536) <= 65535), false)"
    )


def _port_text(x: str) -> str:
    port, scheme = part(x, 4), f"lower({part(x, 1)})"
    default = f"(case {scheme} when 'http' then '80' when 'https' then '443' when 'ws' then '80' when 'wss' then '443' end)"
    number = f"cast(try_cast({port} as integer) as varchar)"
    return f"(case when try_cast({port} as integer) is null or {number} = {default} then '' else ':' || {number} end)"


def normal_url(x: str) -> str:
    return f"(lower({part(x, 1)}) || '://' || lower({part(x, 3)}) || {_port_text(x)} || rtrim({part(x, 5)}, '/') || {part(x, 6)})"


def web_url(x: str) -> str:
    path = part(x, 5)
    return (
        f"(lower({part(x, 1)}) || '://' || {part(x, 2)} || lower({part(x, 3)}) || {_port_text(x)} "
        f"|| case when {path} = '' then '/' else {path} end || {part(x, 6)} || {part(x, 7)})"
    )


# bech32 alphabet, checksum generator, and the checksum's state behind "npub1".
ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (996825010, 642813549, 513874426, 1027748829, 705979059)
NPUB_STATE = 393457147


def npub(x: str) -> str:
    """Text form of a hex key, three hex digits around every 5-bit group."""
    digit = lambda i: f"(instr('0123456789abcdef', substr({x} || '000', {i}, 1)) - 1)"
    at = "((i * 5) // 4 + 1)"
    group = f"((({digit(at)} * 256 + {digit(at + ' + 1')} * 16 + {digit(at + ' + 2')}) >> (7 - (i * 5) % 4)) & 31)"
    data = f"list_transform(range(0, 52), lambda i: cast({group} as bigint))"

    def step(state: str, value: str) -> str:
        out = f"xor((({state} & 33554431) << 5), {value})"
        for bit, g in enumerate(GENERATOR):
            out = f"xor({out}, (({state} >> {25 + bit}) & 1) * {g})"
        return out

    full = f"list_concat([cast({NPUB_STATE} as bigint)], {data}, [cast(0 as bigint), 0, 0, 0, 0, 0])"
    state = f"xor(list_reduce({full}, lambda a, b: {step('a', 'b')}), 1)"
    check = f"list_transform([25, 20, 15, 10, 5, 0], lambda s: (({state}) >> s) & 31)"
    letters = lambda v: f"array_to_string(list_transform({v}, lambda q: substr('{ALPHABET}', cast(q as integer) + 1, 1)), '')"
    return f"('npub1' || {letters(data)} || {letters(check)})"


def day(x: str) -> str:
    return f"cast(make_timestamp(cast({x} as bigint) * 1000000) as date)"


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
RECEIVED = "'Received'"

VIEWS: dict[str, str] = {
    "raw": """select event_id, user_id, event_type, props, cast(floor(epoch(ts)) as bigint) as created_at,
        regexp_extract(props, '"k": *([0-9]+)', 1) as k from events""",
    "shaped": f"""select event_id, user_id, {H('user_id')} as pubkey, created_at,
        case event_type when 'view' then 14 when 'click' then 1059 when 'purchase' then 15 when 'signup' then 10050 else 13 end as kind,
        case when event_type = 'signup' then [['relay', 'wss://Relay' || (event_id % 5) || '.example.com/']]
             else [['p', {H('(user_id * 7 + event_id) % 150')}], ['k', k]] end as tags, props as content from raw""",
    "v_events": f"select *, {event_hash()} as id from shaped",
    "v_bad": """select event_id, pubkey, created_at + case when event_id % 13 = 0 then 1 else 0 end as created_at, kind, tags, content,
        case when event_id % 17 = 0 then upper(id) else id end as id from v_events""",
    "v_copies": """select e.*, r.relay, created_at + r.relay * 17 + event_id % 90
          + case when event_id % 50 = 0 then 259200 else 0 end as arrival
        from v_events e, (values (0), (1), (2)) r(relay) where r.relay <= event_id % 3""",
    "v_messages": f"""select 'm' || event_id as id, event_id as seq, {H('user_id')} as peer,
        case when event_type in ('view', 'click') then {H('user_id')} else {H(ME)} end as author, props as text,
        (created_at // 900) * 900 as created_at,
        case event_type when 'view' then 'Received' when 'click' then 'Received' when 'purchase' then 'Sent'
          when 'error' then 'Failed' else 'Sending' end as status from raw""",
    "v_contacts": f"""select c_custkey, {H('c_custkey')} as pubkey,
        case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then '  ' else c_name end as name,
        c_custkey % 11 = 0 as is_blocked, c_custkey % 3 = 0 and c_custkey % 11 <> 0 as is_request,
        {EPOCH} + (c_custkey * 7919) % 2592000 as last_read_at,
        case when c_custkey % 4 = 0 then [] else ['wss://inbox' || (c_custkey % 9) || '.example.com'] end as inbox_relays,
        {NOW} - (c_custkey * 37) % 43200 as fetched_at from customer""",
    "named": f"""select *, case when trim(coalesce(name, '')) = '' then
          substr({npub('pubkey')}, 1, 12) || '…' || right({npub('pubkey')}, 6) else name end as title from v_contacts""",
    "spans": f"""select {H('user_id')} as peer, {EPOCH} + (user_id % 10) * {DAY} as a,
        case when user_id % 2 = 0 then {EPOCH} + (user_id % 10) * {DAY} + 3 * {DAY} end as b
        from (select distinct user_id from events)""",
    "v_attempts": """select l_orderkey as message_id, l_suppkey as relay, cast(1 as integer) as attempt,
        case when bool_or(l_returnflag = 'A') then 'accepted' when bool_or(l_returnflag = 'R') then 'rejected' else 'pending' end as outcome,
        cast(epoch(min(l_shipdate)) as bigint) as sent_at, cast(epoch(min(l_shipdate)) as bigint) + l_suppkey % 45 as acked_at
        from lineitem group by l_orderkey, l_suppkey""",
    # What each attempt comes to, worked out from how the answers are laid out.
    "answered": """select message_id, relay, attempt, sent_at, outcome = 'pending' as silent, relay % 11 = 0 as asked,
          relay % 11 = 0 and message_id % 5 = 0 as no_second, outcome = 'accepted' as ok, relay % 7 = 0 as dup, acked_at,
          acked_at + case when relay % 11 = 0 then 2 else 0 end as final_at from v_attempts""",
    "matched": """select message_id, relay, attempt, sent_at,
          not silent and not no_second and final_at <= sent_at + 30 as heard,
          case when ok then '' when dup then 'duplicate: already have it' else 'blocked: not here' end as words, ok, dup, final_at
        from answered""",
    "v_matched": """select message_id, relay, attempt, sent_at, heard and (ok or dup) as accepted,
          case when heard then words else 'timed out' end as answer, case when heard then final_at end as acked_at from matched""",
    "v_urls": """select page_id, case when page_id % 5 = 0 then '  ' || u || '  ' else u end as url, u from (
        select page_id, case when page_id % 4 = 0 then regexp_extract(url, '^([a-z]+://)', 1) || upper(regexp_extract(url, '://([^/?#]+)', 1))
          || case when url like 'https:%' then ':443' else ':80' end || regexp_extract(url, '://[^/?#]+(.*)$', 1) else url end as u from pages)""",
    "v_files": f"""select page_id, {H('page_id')} as pubkey, {EPOCH} + page_id as created_at, sha256(html) as x, url, strlen(html) as n_bytes,
        page_id % 9 <> 0 and page_id % 10 <> 0 as readable,
        case page_id % 4 when 0 then 'image/JPEG' when 1 then 'video/mp4' when 2 then 'audio/mp4' end as mime,
        {H('page_id')} as key, substr({H('page_id + 1')}, 1, 24) as nonce,
        case when page_id % 4 = 1 then page_id % 4000 + 0.25 end as duration,
        list_transform(range(0, page_id % 3), lambda i: 'https://mirror' || i || '.example.com/' || sha256(html)) as fallbacks from pages""",
    "file_tags": """select *, list_concat(
          [['file-type', coalesce(lower(mime), 'application/octet-stream')], ['encryption-algorithm', 'aes-gcm'],
           ['decryption-key', key], ['decryption-nonce', nonce], ['x', x], ['size', cast(n_bytes as varchar)]],
          case when duration is null then [] else [['duration', (page_id % 4000) || '.25']] end,
          list_transform(fallbacks, lambda u: ['fallback', u])) as tags from v_files where readable""",
    "v_blobs": """select doc_id, s.server, 'https://server' || s.server || '.example.com/' || doc_id as url,
        case when (doc_id + s.server) % 3 = 0 then text || 'x' else text end as content, sha256(text) as expected, text
        from documents, (values (0), (1), (2)) s(server) where (doc_id + s.server) % 7 <> 0""",
    "v_layers": f"""select e.*, {H('event_id + 3000000')} as wrap_id, {H('(user_id * 7 + event_id) % 150')} as owner,
        created_at + event_id % 90 as arrival,
        case when event_id % 23 = 0 or event_id % 29 = 0 then 'not a seal' when event_id % 31 = 0 then 'impersonation'
          when event_id % 37 = 0 then 'bad rumor id' else 'ok' end as reason from v_events e""",
    "p_values": f"""select *, case when kind = 10050 then [] else [{H('(user_id * 7 + event_id) % 150')}] end as p from v_layers""",
    "folded": f"""select *, case when pubkey = owner then 'Sent' else 'Received' end as status,
        case when pubkey = owner then list_filter(p, lambda q: q <> owner)[1] else pubkey end as peer
        from p_values where reason = 'ok' and kind = 14 and content <> '' and event_id % 11 <> 0""",
    "owner_spans": f"""select distinct {H('(user_id * 7 + event_id) % 150')} as owner, {H('user_id')} as peer, {EPOCH} + (user_id % 10) * {DAY} as a,
        case when user_id % 2 = 0 then {EPOCH} + (user_id % 10) * {DAY} + 3 * {DAY} end as b
        from events where (user_id * 7 + event_id) % 150 % 2 = 0""",
    # Only the first copy of a wrap counts, so the repeats have no place here.
    "v_inbox": """select f.* from folded f where peer is not null and not exists (select 1 from owner_spans s
        where s.owner = f.owner and s.peer = f.peer and f.status = 'Received' and f.arrival >= s.a and (s.b is null or f.arrival < s.b))""",
    "newest": "select *, row_number() over (partition by peer order by created_at desc, seq) as rn from v_messages",
    "unread": f"""select m.peer, count(*) as unread_count from v_messages m join v_contacts c on c.pubkey = m.peer
        where m.status = 'Received' and m.created_at > c.last_read_at group by m.peer""",
    "chats": f"""select c.pubkey, c.title, c.name, c.is_request, l.id, l.created_at, l.text, l.status, coalesce(u.unread_count, 0) as unread_count
        from named c left join newest l on l.peer = c.pubkey and l.rn = 1 left join unread u on u.peer = c.pubkey where not c.is_blocked""",
    "marked": """select *, status <> 'Received' as is_outgoing,
        lag(created_at) over w as p_at, lag(status <> 'Received') over w as p_out from v_messages
        window w as (partition by peer order by created_at, id)""",
    "lists": """select pubkey, relays, created_at, id from (
        select pubkey, id, created_at, case when len(tags) = 0 then [] else ['wss://relay' || (event_id % 5) || '.example.com'] end as relays,
          row_number() over (partition by pubkey, relay order by created_at desc, id) as rn from list_copies where kind = 10050)
        where rn = 1 and len(relays) > 0""",
    "list_copies": "select * from v_copies",
    "v_uploads": """select doc_id, s.pos, t.label, sha256(text) as sha, (doc_id + s.pos) % 4 = 0 as picky, (doc_id + s.pos) % 5 < 2 as down
        from documents, (values (0), (1), (2)) s(pos), (values (0), (1)) t(label)
        where t.label = 0 or (doc_id + s.pos) % 4 = 0""",
    # The deciding try is the second label where the first is refused, so only down or changed matter.
    "v_outcomes": """select doc_id, pos, sha, case when down then 'media' || pos || '.example.com: 503 Unavailable'
          when doc_id % 10 = 3 then 'media' || pos || '.example.com: changed the file' end as error,
        case when down or doc_id % 10 = 3 then null when doc_id % 2 = 0 then 'https://cdn' || pos || '.example.com/' || sha
          else 'https://Media' || pos || '.example.com/' || sha end as url
        from v_uploads where not (picky and label = 0)""",
    "v_uploaded": """select doc_id, any_value(sha) as sha, list(url order by pos) filter (url is not null) as urls,
        list(error order by pos) filter (error is not null) as errors from v_outcomes group by doc_id""",
}


def sql(uses: str, body: str, **overrides: str) -> str:
    """``body`` behind the views it uses, in the given order."""
    views = {**VIEWS, **overrides}
    return "with " + ",\n".join(f"{name} as ({views[name]})" for name in uses.split()) + "\n" + body


EVENTS = "raw shaped v_events"
CHATS = "raw v_messages v_contacts named newest unread chats"

ORACLES: dict[str, str] = {}


def _event_frames() -> str:
    return sql(EVENTS, """
        select event_id, 'EVENT' as verb, 'inbox' as sub_id, id, null as message_id, cast(null as boolean) as ack_ok, null as ack_text,
          null as text, null as problem from v_events where event_id % 19 <> 0 and event_id % 23 <> 0
        union all select event_id, '', null, null, null, null, null, null, 'not JSON' from v_events where event_id % 19 = 0
        union all select event_id, 'EVENT', 'inbox', null, null, null, null, null, 'malformed event' from v_events
          where event_id % 23 = 0 and event_id % 19 <> 0
        union all select event_id, 'OK', null, null, id, case event_id % 3 when 0 then true when 1 then false end,
          case event_id % 3 when 1 then 'blocked: no' else '' end, null, case when event_id % 3 = 2 then 'malformed answer' end from v_events
        union all select event_id, 'EOSE', 'inbox', null, null, null, null, null, null from v_events where event_id % 10 = 0
        union all select event_id, 'CLOSED', 'inbox', null, null, null, null, 'auth-required: x', null from v_events where event_id % 10 = 1
        union all select event_id, 'AUTH', null, null, null, null, null, 'ch' || event_id, null from v_events where event_id % 10 = 2
        union all select event_id, 'NOTICE', null, null, null, null, null, '', null from v_events where event_id % 10 = 3""")


ORACLES["s1_parse_frames"] = _event_frames()
_BAD_EVENT = "event_id % 13 = 0 or event_id % 17 = 0 or event_id % 19 = 0"
ORACLES["s2_parse_events"] = sql(EVENTS, f"""
    select event_id, id, created_at, kind,
      case when event_id % 29 = 0 and event_id % 23 <> 0 then '[["x",""],' || substr({tags_text('tags')}, 2) else {tags_text('tags')} end as tags,
      content, cast(null as varchar) as sig from v_events where not ({_BAD_EVENT})
    union all select event_id, null, null, null, null, null, null from v_events where {_BAD_EVENT}""")
ORACLES["s3_events_to_json"] = sql(EVENTS, f"""select event_id, {event_text(
    '''|| case when event_id % 2 = 0 then ',"sig":"' || id || id || '"' else '' end''')} as json from v_events""")
_RELAYS = "'wss://relay.damus.io,wss://nos.lol,wss://relay.primal.net,wss://nostr.mom,wss://offchain.pub'"
_SERVERS = "'https://blossom.primal.net,https://24242.io'"
ORACLES["s4_read_snapshot"] = f"""select part, value, count(*) as n from (
    select 'contact' as part, {H('c_custkey + 1')} || '|' || c_name || '|' || case when c_custkey % 3 = 0 then 'true' else 'false' end as value
      from customer where c_custkey % 2 = 0
    union all select 'settings', case when c_custkey % 4 = 1 then 'wss://relay.example' else {_RELAYS} end || '|' ||
      case when c_custkey % 4 = 2 then 'https://m.example' else {_SERVERS} end from customer
    union all select 'last sync', cast(case when c_custkey % 5 = 0 then c_custkey else 0 end as varchar) from customer) group by part, value"""
ORACLES["s4_snapshot_files"] = f"""select part, value, count(*) as n from (
    select 'contacts' as part, {H('c_custkey')} || '|' || c_name || '|' || case when c_custkey % 3 = 0 then 'true' else 'false' end as value from customer
    union all select 'messages', 'm' || c_custkey || '|' || {H('c_custkey')} || '|' || c_name || '|' || ({EPOCH} + c_custkey) from customer
    union all select 'processed', {H('c_custkey + 1')} from customer where c_custkey % 7 = 0
    union all select 'settings', case when k % 2 = 0 then 'wss://relay.example' else {_RELAYS} end || '|' || {_SERVERS} from (select distinct c_custkey // 1000 as k from customer)
    union all select 'last_sync', cast(case when k % 3 = 0 then k else 0 end as varchar) from (select distinct c_custkey // 1000 as k from customer)) group by part, value"""
ORACLES["s6_read_blobs"] = """select item_id, cast(strlen(text) + 1 as bigint) as length, sha256(text || chr(10)) as sha256 from benchmark"""
ORACLES["s5_snapshot_round_trip"] = sql("raw v_messages v_contacts", """
    select 'message' as part, id as key, created_at as at_time from v_messages
    union all select 'contact', pubkey, last_read_at from v_contacts""").replace("at_time", '"at"')
ORACLES["s6_address_blobs"] = sql("v_blobs", "select url, sha256(content) as sha256, cast(strlen(content) as bigint) as length from v_blobs")
ORACLES["s7_stream_events"] = sql("raw", f"select event_id, {H('user_id')} as pubkey, event_type, props, created_at from raw")
_KINDS = "[14, 1059, 15, 10050, 13]"
ORACLES["s8_parse_subscriptions"] = f"""select 's' || c_custkey as sub_id, 0 as filter_no, true as any_id,
    case when c_custkey % 4 = 0 then null when c_custkey % 20 = 19 then '' else cast({_KINDS}[c_custkey % 5 + 1] as varchar) end as kinds,
    case when c_custkey % 3 <> 0 then {H('c_custkey')} || '|' || {H('c_custkey + 20')} end as p_values,
    case when c_custkey % 6 = 5 then {H('c_custkey')} || '|' || {H('c_custkey + 5')} end as authors,
    case when c_custkey % 9 = 4 then 61 end as n_k,
    case when c_custkey % 5 <> 0 then {EPOCH} + (c_custkey % 20) * {DAY} end as since,
    case when c_custkey % 7 = 3 then {EPOCH} + (c_custkey % 20 + 12) * {DAY} end as until, 5 as lim from customer"""
ORACLES["s8_quarantined_subscriptions"] = """select 's' || c_custkey as sub_id, cast(0 as integer) as filter_no,
    ['kinds', 'kinds', 'ids', 'tags', 'since', 'filter', 'none'][c_custkey % 7 + 1] as problem from customer
    union all select 's' || c_custkey, 1, 'none' from customer where c_custkey % 7 = 4"""

ORACLES["e1_tag_values"] = sql("raw", f"""select event_id,
    case when event_type = 'signup' then '' else {H('(user_id * 7 + event_id) % 150')} end as p,
    case when event_type = 'signup' then null else k end as k,
    case when event_type = 'signup' then 'wss://Relay' || (event_id % 5) || '.example.com/' end as relay from raw""")
_ODD = "text || case when doc_id % 4 = 0 then chr(1) || chr(31) || chr(11) || '\"\\' else '' end"
ORACLES["e2_json_escape"] = f"""select doc_id, cast(strlen(e) as integer) as n_bytes, sha256(e) as digest
    from (select doc_id, '"' || {esc('odd')} || '"' as e from (select doc_id, {_ODD} as odd from documents))"""
ORACLES["e3_event_id"] = sql(EVENTS, "select event_id, id from v_events")
ORACLES["e3_event_id_documents"] = f"""select doc_id, {event_hash()} as id from (select doc_id, {H('doc_id')} as pubkey,
    {EPOCH} + doc_id as created_at, 14 as kind, [['source', source], ['lang', lang]] as tags, text as content from documents)"""
ORACLES["e4_is_lower_hex"] = sql(EVENTS + " v_bad", """select event_id, event_id % 17 <> 0 or id = lower(id) as id_ok,
    false as sig_ok, lower(id) as again from v_bad""")
ORACLES["e5_participants"] = sql(EVENTS, f"""select event_id, array_to_string(list_sort(list_distinct(list_filter(
    list_concat({values('tags', 'p')}, [pubkey]), lambda q: q <> {H('event_id % 150')}))), '|') as others from v_events""")
ORACLES["e6_relay_urls"] = sql("v_urls", f"""select page_id, {web_ok('u')} as valid, {normal_url('u')} as normal, false as onion from v_urls""")
ORACLES["e7_media_servers"] = sql("v_urls", f"""select owner, array_to_string(list_filter(seen, lambda q: q is not null), '|') as servers, ok as proxy_ok from (
    select page_id // 5 as owner, arg_min({web_ok('u')}, page_id) as ok, list(rtrim(u, '/') order by page_id) filter (first_seen) as seen
    from (select *, {web_ok('u')} and row_number() over (partition by page_id // 5, rtrim(u, '/') order by page_id) = 1 as first_seen from v_urls)
    group by page_id // 5)""")
ORACLES["e8_attachment_from_event"] = sql("v_files", f"""select page_id, readable, case when readable then {web_url('url')} end as url,
    case when readable then coalesce(lower(mime), 'application/octet-stream') end as mime, case when readable then key end as key,
    case when readable then nonce end as nonce, case when readable then x end as encrypted_sha256, cast(null as varchar) as plain_sha256,
    case when readable then cast(n_bytes as bigint) end as size, cast(null as varchar) as dimensions,
    case when readable then cast(duration as double) end as duration_seconds,
    case when readable then array_to_string(fallbacks, '|') end as fallbacks from v_files""")
ORACLES["e9_attachment_to_tags"] = sql("v_files file_tags", f"select page_id, {tags_text('tags')} as tags from file_tags")
ORACLES["e10_attachment_kind"] = sql("v_files", """select page_id,
    case when mime ilike 'image/%' then 'Image' when mime ilike 'video/%' then 'Video' when mime ilike 'audio/%' then 'Audio' else 'File' end as kind,
    case when mime ilike 'image/%' then '📷 Photo' when mime ilike 'video/%' then '🎥 Video' when mime ilike 'audio/%' then '🎤 Audio'
      else '📎 File' end as label from v_files""")
ORACLES["e11_media_types"] = sql("v_files", """select page_id,
    case when page_id % 3 = 0 then 'audio/mp4' end as from_name,
    case mime when 'image/jpeg' then '.jpg' when 'video/mp4' then '.mp4' when 'audio/mp4' then '.m4a' else '.bin' end as extension,
    'application/octet-stream' || case when mime is null then '' else '|' || mime end
      || case when mime = 'audio/mp4' then '|audio/mpeg|video/mp4' else '' end as labels
    from (select page_id, lower(mime) as mime from v_files)""")
ORACLES["e12_padded_length"] = """select size_class, count(*) as n_messages, min(n) as shortest, max(n) as longest from (
    select n, case when n <= 32 then 32 else ((n - 1) // step + 1) * step end as size_class from (
      select n, case when p <= 256 then 32 else p // 8 end as step from (
        select n, cast(pow(2, floor(log2(greatest(n - 1, 1))) + 1) as bigint) as p from (
          select greatest(n_chars, 1) as n from documents)))) group by size_class"""
_INITIAL = "case when trim(coalesce(name, '')) = '' then '?' else upper(substr(trim(name), 1, 1)) end"
_BUCKET = "cast(((instr('0123456789abcdef', substr(pubkey, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(pubkey, 2, 1)) - 1) % 10 as integer)"
ORACLES["e13_display_names"] = sql("v_contacts named", f"""select pubkey, title as display_name, {_BUCKET} as bucket,
    {_INITIAL} as initial from named""")


def _age_label(x: str, now: int, today: str, older: str) -> str:
    age = f"date_diff('day', {day(x)}, {day(str(now))})"
    stamp = f"make_timestamp(cast({x} as bigint) * 1000000)"
    return (
        f"(case when {age} = 0 then {today} when {age} = 1 then 'Yesterday' when {age} < 7 then strftime({stamp}, '%A') "
        f"else strftime({stamp}, '{older}') end)"
    )


def _time_label(x: str, now: int) -> str:
    return _age_label(x, now, f"strftime(make_timestamp(cast({x} as bigint) * 1000000), '%H:%M')", "%m/%d/%Y")


def _day_label(x: str, now: int) -> str:
    return _age_label(x, now, "'Today'", "%A, %d %B %Y")


ORACLES["e14_labels"] = sql("raw v_messages", f"""select id, {_day_label('created_at', NOW - 10 * DAY)} as day,
    {_time_label('created_at', NOW - 10 * DAY)} as time,
    case when s >= 3600 then (s // 3600) % 24 || ':' || lpad(cast((s // 60) % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0')
      else s // 60 || ':' || lpad(cast(s % 60 as varchar), 2, '0') end as duration,
    case when b < 1048576 then greatest(1, b // 1024) || ' KB' when tenths % 10 = 0 then tenths // 10 || ' MB'
      else tenths // 10 || '.' || tenths % 10 || ' MB' end as size
    from (select id, created_at, (seq * 7) % 90000 as s, (seq * 7919) % 9000000 as b,
      (((seq * 7919) % 9000000) * 20 + 1048576) // 2097152 as tenths from v_messages)""")
ORACLES["e15_build_events"] = sql("v_files file_tags v_contacts", f"""
    select row_key, kind, {event_hash()} as id, {tags_text('tags')} as tags from (
      select conv_id || '-' || turn as row_key, 14 as kind, {H('conv_id')} as pubkey, {EPOCH} + conv_id * 3600 + turn * 173 as created_at,
        text as content, list_concat([['p', {H('conv_id + 1')}]],
          case when turn > 0 then [['e', conv_id || '-' || (turn - 1), '', 'reply']] else [] end) as tags from conversations
      union all select cast(page_id as varchar), 15, pubkey, created_at, {web_url('url')}, list_concat([['p', {H('page_id + 1')}]], tags) from file_tags
      union all select pubkey, 10050, pubkey, fetched_at, '', list_transform(inbox_relays, lambda u: ['relay', u]) from v_contacts)""")

ORACLES["f1_filter_events"] = sql(EVENTS, f"""select event_id, id, kind, created_at from v_events where kind in (14, 1059)
    and created_at between {EPOCH + 5 * DAY} and {EPOCH + 25 * DAY} and cast(regexp_extract(content, '"k": *([0-9]+)', 1) as integer) % 3 = 0""")
ORACLES["f2_fetch_events"] = sql(EVENTS, f"""select distinct id, kind, created_at from (
    (select * from v_events where kind = 1059 order by created_at desc, id limit 50)
    union all (select * from v_events where kind in (14, 1059) and created_at <= {EPOCH + 20 * DAY} order by created_at desc, id limit 40)
    union all select * from v_events where kind = 10050)""")
ORACLES["f3_valid_event_ids"] = sql(EVENTS, "select event_id, id from v_events where event_id % 13 <> 0 and event_id % 17 <> 0")
ORACLES["f4_accept_events"] = sql(EVENTS + " v_bad", f"""select event_id, case when event_id % 3 = 0 then 'unknown subscription'
    when not (kind = 1059 or (kind in (14, 15) and created_at >= {EPOCH + 3 * DAY})) then 'not asked for'
    when event_id % 13 = 0 or event_id % 17 = 0 then 'bad id'
    when event_id % 10 = 0 or event_id % 7 = 0 then 'bad signature' else 'accepted' end as reason from v_bad""")
ORACLES["f5_chat_payloads"] = sql("v_files", """
    select conv_id || '-' || turn as row_key, 14 as kind, null as mime from conversations where conv_id % 4 <> 0 and text <> ''
    union all select cast(page_id as varchar), 15, coalesce(lower(mime), 'application/octet-stream') from v_files where readable""")
ORACLES["f6_readable_by"] = sql(EVENTS, f"select event_id, kind from v_events where kind <> 1059 or (user_id * 7 + event_id) % 150 = 7")
ORACLES["f6_wraps_for_readers"] = sql(EVENTS + " v_contacts", f"""select event_id, c.pubkey as reader from v_events e
    join v_contacts c on c.c_custkey = (e.user_id * 7 + e.event_id) % 150 where e.kind = 1059 and c.is_request""")
ORACLES["f7_chat_list_filter"] = sql(CHATS, """
    select 'unread' as tab, pubkey, title, unread_count from chats where unread_count > 0
      and (contains(lower(title), 'customer#0000000') or contains(lower(coalesce(text, '')), 'customer#0000000'))
    union all select 'requests', pubkey, title, unread_count from chats where is_request
      and (contains(lower(title), '"k": 1') or contains(lower(coalesce(text, '')), '"k": 1'))""")
_B64 = "(67 + case when n <= 32 then 32 else ((n - 1) // step + 1) * step end + 2) // 3 * 4"
_SEAL_FIXED = len('{"id":"","pubkey":"","created_at":,"kind":13,"tags":[],"content":"","sig":""}') + 64 + 64 + 10 + 128
ORACLES["f8_validate_outgoing"] = f"""with drafts as (select doc_id, {H('doc_id')} as id, {H(ME)} as pubkey, {EPOCH} + doc_id as created_at, 14 as kind,
      [['p', {H('doc_id % 1000')}]] as tags,
      case when doc_id % 17 = 0 then '' else trim(text, {BLANKS}) end as content from documents),
    sized as (select doc_id, content, cast(strlen({event_text()}) as bigint) as n from drafts),
    powers as (select *, cast(pow(2, floor(log2(n - 1)) + 1) as bigint) as p from sized),
    steps as (select *, case when p <= 256 then 32 else p // 8 end as step from powers)
    select doc_id, n as rumor_bytes, cast({_B64} + {_SEAL_FIXED} as bigint) as seal_bytes,
      case when content = '' then 'empty' when (doc_id % 1000) % 11 = 0 and exists (select 1 from customer where c_custkey = doc_id % 1000) then 'blocked'
        when n > 65535 or {_B64} + {_SEAL_FIXED} > 65535 then 'too long' else 'ok' end as reason from steps"""
ORACLES["f8_validate_files"] = """select page_id, n_bytes, case when n_bytes = 0 then 'empty' when n_bytes > 67108864 then 'too large'
    when page_id % 11 = 0 and exists (select 1 from customer where c_custkey = page_id) then 'blocked' else 'ok' end as reason
    from (select page_id, cast(strlen(html) as bigint) * (page_id % 40) * 300 as n_bytes from pages)"""
ORACLES["f9_failed_messages"] = """select 'm' || event_id as id, case when event_id % 6 = 0 then 'upload' else 'publish' end as retry
    from events where event_type = 'error'"""
ORACLES["f10_find"] = f"""select 'm7' as id from events where event_id = 7
    union all select {H('c_custkey')} from customer where c_custkey in (select o_custkey from orders)"""

_ASKED = f"""(n_nationkey % 4 = 0 or (n_nationkey % 20 <> 19 and e.kind = {_KINDS}[n_nationkey % 5 + 1]))
      and (n_nationkey % 3 = 0 or (e.kind <> 10050 and (e.user_id * 7 + e.event_id) % 150 in (n_nationkey, n_nationkey + 20)))
      and (n_nationkey % 5 = 0 or e.created_at >= {EPOCH} + (n_nationkey % 20) * {DAY})
      and (n_nationkey % 7 <> 3 or e.created_at <= {EPOCH} + (n_nationkey % 20 + 12) * {DAY})
      and (n_nationkey % 6 <> 5 or e.user_id in (n_nationkey, n_nationkey + 5))
      and (n_nationkey % 9 <> 4 or cast(regexp_extract(e.content, '"k": *([0-9]+)', 1) as integer) <= 60)"""
ORACLES["j1_match_subscriptions"] = sql(EVENTS, f"""select 's' || n_nationkey as sub_id, e.id from nation n, v_events e
    where {_ASKED}
      and n_nationkey <> 0""")
ORACLES["f4_accept_events_table"] = sql(EVENTS, f"""select event_id, case when n_nationkey is null then 'unknown subscription'
    when not ({_ASKED}) then 'not asked for' when event_id % 10 = 0 or event_id % 7 = 0 then 'bad signature' else 'accepted' end as reason
    from v_events e left join nation n on n_nationkey = event_id % 30""")
ORACLES["j1_match_all"] = "select 's0' as sub_id"
# The seal of every 31st event is signed with the key of the number of the event, which is its author's own where the two numbers are the same.
ORACLES["j2_authenticate_layers"] = sql(EVENTS, f"""select wrap_id, reason, case when reason = 'ok' then id end as rumor_id from (
    select id, {H('event_id + 3000000')} as wrap_id, case when event_id % 23 = 0 or event_id % 29 = 0 then 'not a seal'
      when event_id % 31 = 0 and {H('event_id')} <> pubkey then 'impersonation' when event_id % 37 = 0 then 'bad rumor id' else 'ok' end as reason
    from v_events)""")
ORACLES["j3_conversations"] = sql(CHATS, "select pubkey, id as last_id, created_at as last_at, unread_count from chats")
ORACLES["j4_drop_blocked"] = sql("raw v_messages spans", """select id, peer, status from v_messages m where status <> 'Received' or not exists (
    select 1 from spans s where s.peer = m.peer and m.created_at >= s.a and (s.b is null or m.created_at < s.b))""")
ORACLES["j4_drop_blocked_now"] = sql("raw v_messages v_contacts", """select id, peer, status from v_messages
    where status <> 'Received' or peer not in (select pubkey from v_contacts where is_blocked)""")
_BEST = "(select pubkey, arg_min(relays, {'a': -created_at, 'b': id}) as relays, max(created_at) as listed_at from lists group by pubkey)"
ORACLES["j5_resolve_inbox_relays"] = sql(EVENTS + " v_copies list_copies lists v_contacts", f"""
    select c.pubkey, array_to_string(case when len(inbox_relays) > 0 and {NOW} - fetched_at < 21600 then inbox_relays
        when b.relays is not null then b.relays when len(inbox_relays) > 0 then inbox_relays else ['wss://own.example.com'] end, '|') as relays,
      case when len(inbox_relays) > 0 and {NOW} - fetched_at < 21600 then 'cache' when b.relays is not null then 'list'
        when len(inbox_relays) > 0 then 'stale cache' else 'own' end as source
    from v_contacts c left join {_BEST} b on b.pubkey = c.pubkey""")
ORACLES["j6_import_contacts"] = f"""with parsed as (select case when c_custkey % 5 < 3 then
      {H('c_custkey - (c_custkey % 3) * case when c_custkey % 6 = 1 then 1 else 0 end')} end as key from customer)
    select 'accepted' as outcome, key, 63 as n_chars from (select distinct key from parsed where key is not null and key <> {H(10)})
    union all select reason, '', cast(count(*) as integer) from (
      select case when key is null then 'invalid key' else 'own key' end as reason from parsed where key is null or key = {H(10)}) group by reason"""
ORACLES["j7_match_acks"] = sql("v_attempts answered matched v_matched", "select * from v_matched")
ORACLES["j8_relay_status"] = """select owner, cast(row_number() over (partition by owner order by s_suppkey) - 1 as integer) as pos, url,
    case s_suppkey % 4 when 0 then '● connected' when 1 then '○ connecting…' else
      case when s_suppkey % 8 = 2 then '✕ no route' else '✕ offline' end end as status,
    s_suppkey % 5 = 0 as is_onion, s_suppkey % 4 = 0 as is_connected
    from (select s_suppkey // 5 as owner, s_suppkey, 'wss://r' || s_suppkey || case when s_suppkey % 5 = 0 then '.onion' else '.example.com' end as url from supplier)"""
ORACLES["j9_resolve_replies"] = """select a.conv_id || '-' || a.turn as id, case when a.turn > 0 then a.conv_id || '-' || (a.turn - 1) end as reply_to,
    b.role as parent_author, cast(length(b.text) as integer) as parent_chars
    from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1"""
ORACLES["j10_fetch_blobs"] = sql("v_blobs", """select d.doc_id as file_id, cast(h.pos as integer) as pos,
    case when h.pos is not null then 'https://server' || h.pos || '.example.com/' || d.doc_id end as url
    from documents d left join (select doc_id, min(server) as pos from v_blobs where sha256(content) = expected group by doc_id) h on h.doc_id = d.doc_id""")
ORACLES["j10_blob_locations"] = sql("v_files", f"""select page_id as file_id, x as expected_sha256, cast(i - 1 as integer) as pos, places[i] as url from (
    select page_id, x, unnest(range(1, len(places) + 1)) as i, places from (
      select page_id, x, list_concat([{web_url('url')}], fallbacks, ['https://m1.example.com/' || x, 'https://m2.example.com/' || x]) as places
      from v_files where readable))""")

ORACLES["a1_last_message"] = sql("raw v_messages newest", "select peer, id, created_at, text, status from newest where rn = 1")
ORACLES["a2_unread_counts"] = sql("raw v_messages v_contacts unread", "select peer, unread_count from unread")
_STATES = """select o_orderkey as message_id, case when coalesce(a, 0) > 0 then 'Sent' when coalesce(p, 0) = 0 then 'Failed' else 'Sending' end as status,
      cast(coalesce(a, 0) as bigint) as relays_accepted from orders left join (
        select message_id, count(*) filter (outcome = 'accepted') as a, count(*) filter (outcome = 'pending' and sent_at + 30 > 883612800) as p
        from v_attempts group by message_id) on message_id = o_orderkey"""
ORACLES["a3_delivery_status"] = sql("v_attempts", _STATES)
ORACLES["a4_delivery_ticks"] = sql("v_attempts", f"""select *, case status when 'Sending' then 'clock' when 'Failed' then 'error'
    else case when relays_accepted > 1 then 'two ticks' else 'one tick' end end as tick, status = 'Sent' and relays_accepted > 1 as widely_stored
    from ({_STATES})""")
_URL_OUT = "coalesce(urls, [])"
ORACLES["a5_upload_results"] = sql("v_uploads v_outcomes v_uploaded", f"""select doc_id as file_id, array_to_string({_URL_OUT}, '|') as urls,
    array_to_string(coalesce(errors, []), '|') as errors, {_URL_OUT}[1] as primary_url, array_to_string({_URL_OUT}[2:], '|') as fallbacks,
    case when len({_URL_OUT}) > 0 then 'Uploaded' else 'Failed' end as status from v_uploaded""")
ORACLES["a6_connection_summary"] = """select connected, total, connected = 0 as is_offline,
    case when connected = 0 then 'Connecting…' else 'Connected to ' || connected || ' of ' || total || ' relays' end as text
    from (select count(*) filter (s_acctbal > 0) as connected, count(*) as total from supplier)"""
ORACLES["a7_sync_high_water"] = sql("raw", f"""select coalesce(a.sub_id, b.sub_id) as sub_id, greatest(a.t, b.t) as last_sync_at from
    (select 'u' || user_id as sub_id, max(created_at) as t from raw group by user_id) a full join
    (select 'u' || c_custkey as sub_id, {EPOCH} + (c_custkey * 86000) % 2600000 as t from customer) b on a.sub_id = b.sub_id""")
ORACLES["a8_plaintext_leaks"] = "select doc_id as id, item_id from documents d join benchmark b on contains(d.text, b.text)"
ORACLES["a8_leak_audit"] = f"""select 'signed by a known identity' as "check", count(*) as n from events
      where event_id % 97 = 0 and event_id % 150 in (select c_custkey from customer)
    union all select 'time outside the allowed range', count(*) from events where event_id % 101 = 0
    union all select 'known plain text in content', count(distinct id) from ({ORACLES['a8_plaintext_leaks']})"""

_EMPTIED = "select event_id, pubkey, id, created_at, kind, relay, case when event_id % 3 = 2 and relay = 1 then [] else tags end as tags from v_copies"
ORACLES["w1_latest_inbox_list"] = sql(EVENTS + " v_copies list_copies lists", f"""select pubkey, array_to_string(relays, '|') as relays, listed_at
    from {_BEST}""", list_copies=_EMPTIED)
_NEW_DAY = f"(p_at is null or {day('created_at')} <> {day('p_at')})"
_STARTS = f"({_NEW_DAY} or is_outgoing <> p_out or created_at - p_at > {{gap}})"
ORACLES["w2_timeline"] = sql("raw v_messages marked", f"""select peer, id, created_at, {_NEW_DAY} as new_day, {_STARTS.format(gap=300)} as starts_group from marked""")
ORACLES["w3_message_groups"] = sql("raw v_messages marked", f"""select peer, group_no, count(*) as n_messages, min(created_at) as first_at,
    max(created_at) as last_at, bool_or(is_outgoing) as is_outgoing, bool_or(new_day) as opens_day from (
      select *, cast(sum(case when starts then 1 else 0 end) over (partition by peer order by created_at, id rows unbounded preceding) as bigint) as group_no
      from (select *, {_NEW_DAY} as new_day, {_STARTS.format(gap=6 * 3600)} as starts from marked)) group by peer, group_no""")
ORACLES["w3_timeline_rows"] = sql("raw v_messages marked", f"""select peer, id, 1 as row_type, text as label from marked
    union all select peer, id, 0, {_day_label('created_at', NOW)} from marked where {_NEW_DAY}""")
ORACLES["w4_rebuild_on_late"] = sql("raw v_messages marked", f"""select peer, id, {_NEW_DAY} as new_day, {_STARTS.format(gap=300)} as starts_group
    from marked where peer in (select peer from v_messages where seq % 97 = 0)""")
_OUT = "status <> 'Received'"
ORACLES["w5_chat_list"] = sql(CHATS, f"""select pubkey, title, {_INITIAL} as initial, trim(coalesce(name, '')) <> '' as has_name, {_BUCKET} as bucket,
    coalesce(text, case when is_request then 'Message request' else 'Tap to start chatting' end) as preview,
    coalesce({_time_label('created_at', NOW)}, '') as time, coalesce(created_at, 0) as last_at, unread_count,
    case when unread_count > 99 then '99+' else cast(unread_count as varchar) end as badge, is_request,
    coalesce(case status when 'Sending' then 'clock' when 'Sent' then 'one tick' when 'Failed' then 'error' end, '') as tick,
    coalesce(status = 'Failed', false) as is_failed, text as last_text from chats""")
ORACLES["w6_contacts_sorted"] = sql("v_contacts named", """select 'all' as tab, pubkey, title as display_name from named
    union all select 'blocked', pubkey, title from named where is_blocked""")
ORACLES["w7_top_n_list"] = sql("v_urls", f"""select owner, array_to_string((list(n order by page_id))[1:3], '|') as inbox from (
    select page_id // 8 as owner, page_id, {normal_url('u')} as n from v_urls where {web_ok('u')}
    qualify row_number() over (partition by page_id // 8, {normal_url('u')} order by page_id) = 1) group by owner""")

ORACLES["x1_merge_relays"] = sql(EVENTS + " v_copies", """select id, relay, arrival from v_copies
    qualify row_number() over (partition by id order by arrival, relay) = 1""")
ORACLES["x2_relay_changes"] = sql("v_urls", f"""select coalesce(a.n, b.n) as url,
    case when a.n is null then 'added' when b.n is null then 'removed' else 'kept' end as change from
    (select distinct {normal_url('u')} as n from v_urls where page_id % 3 <> 0 and {web_ok('u')}) a full join
    (select distinct {normal_url('u')} as n from v_urls where page_id % 2 = 0 and {web_ok('u')}) b on a.n = b.n""")
ORACLES["x3_unprocessed"] = sql(EVENTS, "select event_id, id from v_events where event_id % 3 <> 2")

_CONTACT_OPS = f"""select -1 as seq, pubkey, 'upsert' as op, name, is_request as req, is_blocked as blk, last_read_at as rd from v_contacts
    union all select event_id, {H('user_id')}, op, case when op = 'upsert' then 'u' || k when op = 'add' then nullif(case when cast(k as integer) % 4 = 0 then '' else k end, '') end,
      event_id % 2 = 0, event_id % 3 = 0, created_at from (select *, case when event_id % 41 = 0 then 'remove' when event_id % 43 = 0 then 'upsert' else
        case event_type when 'view' then 'ensure' when 'click' then 'mark_read' when 'purchase' then 'add' when 'signup' then 'block' else 'unblock' end end as op from raw)
      where not (op = 'add' and user_id = 5)"""
ORACLES["c1_apply_contact_changes"] = f"""with raw as ({VIEWS['raw']}), v_contacts as ({VIEWS['v_contacts']}), ops as ({_CONTACT_OPS}),
    live as (select o.* from ops o left join (select pubkey, max(seq) as r from ops where op = 'remove' group by pubkey) d on d.pubkey = o.pubkey
      where o.op <> 'remove' and o.seq > coalesce(d.r, -2)),
    born as (select pubkey, min(seq) as c from live where op in ('upsert', 'add', 'block', 'ensure') group by pubkey),
    after as (select l.* from live l join born b on b.pubkey = l.pubkey and l.seq >= b.c)
    select b.pubkey,
      (select name from after a where a.pubkey = b.pubkey and (op = 'upsert' or (op = 'add' and name is not null)) order by seq desc limit 1) as name,
      (select case op when 'upsert' then req when 'ensure' then req else false end from after a where a.pubkey = b.pubkey
        and (op in ('upsert', 'add', 'block') or (op = 'ensure' and seq = b.c)) order by seq desc limit 1) as is_request,
      coalesce((select case op when 'upsert' then blk else op = 'block' end from after a where a.pubkey = b.pubkey
        and op in ('upsert', 'block', 'unblock') order by seq desc limit 1), false) as is_blocked,
      coalesce((select rd from after a where a.pubkey = b.pubkey and op in ('upsert', 'mark_read') order by seq desc limit 1), 0) as last_read_at
    from born b"""
# How the generated log plays out: suppliers without removals keep every message.
ORACLES["c2_apply_message_changes"] = f"""with rows as (select l_orderkey as k, l_suppkey as s from lineitem group by all),
    last_removal as (select s, max((k * 1000 + (s % 200) * 5) * 10 + 4) as r from rows where s % 50 = 0 group by s)
    select 'm' || k || '-' || s as id, {H('s')} as peer, case when k % 2 = 0 then 'Sent' else 'Sending' end as status from rows where s % 50 <> 0
    union all select 'm' || k || '-' || rows.s, {H('rows.s')}, 'Received' from rows join last_removal d on d.s = rows.s
      where k % 5 = 0 and (k * 1000 + (rows.s % 200) * 5) * 10 + 5 > d.r"""
_FOLD = EVENTS + " v_layers p_values folded owner_spans v_inbox"
ORACLES["c3_fold_inbox"] = sql(_FOLD, """select owner, id, peer, pubkey as author, content as text, created_at, status,
    cast(null as varchar) as reply_to from v_inbox where event_id % 13 <> 0""")
ORACLES["c3_handled"] = f"""select {H('(user_id * 7 + event_id) % 150')} as owner, {H('event_id + 3000000')} as id from events where event_id % 11 <> 0"""
ORACLES["c3_implied_contacts"] = sql(_FOLD, """select owner, peer as pubkey, status = 'Received' as is_request from v_inbox where event_id % 13 <> 0
    qualify row_number() over (partition by owner, peer order by arrival, id) = 1""")
ORACLES["c4_pending_uploads"] = sql("v_uploads v_outcomes v_uploaded", f"""select 'upload-' || file as old_id,
    case when url is null then 'upload-' || file else {event_hash()} end as id, created_at, case when url is null then 'Failed' else 'Sending' end as status from (
      select {H('d.doc_id + 2')} as file, {_URL_OUT}[1] as url, {_URL_OUT}[1] as content, {EPOCH} + d.doc_id as created_at, {H(ME)} as pubkey, 15 as kind,
        list_concat([['p', {H('d.doc_id')}], ['file-type', 'image/png'], ['encryption-algorithm', 'aes-gcm'], ['decryption-key', {H('d.doc_id')}],
          ['decryption-nonce', substr({H('d.doc_id + 1')}, 1, 24)], ['x', {H('d.doc_id + 2')}]],
          case when strlen(d.text) > 0 then [['size', cast(strlen(d.text) as varchar)]] else [] end,
          list_transform({_URL_OUT}[2:], lambda u: ['fallback', u])) as tags
      from documents d join v_uploaded u on u.doc_id = d.doc_id)""")

ORACLES["t1_stream_dedup"] = sql(EVENTS, "select id from v_events")
ORACLES["t2_catch_up_bound"] = sql(EVENTS, f"""select e.pubkey, count(*) as n_wraps, min(since) as since from v_events e join (
      select c_custkey, case when c_custkey % 6 <> 0 then {EPOCH} + (c_custkey * 7919) % 2592000 - 176400 end as since from customer) c
    on c.c_custkey = e.user_id where e.kind = 1059 and (since is null or e.created_at >= since) group by e.pubkey""")
ORACLES["t3_stream_messages"] = ORACLES["c2_apply_message_changes"]
ORACLES["t3_stream_inbox"] = sql(_FOLD, "select owner, id, peer, content as text, status from v_inbox")
ORACLES["t4_stream_delivery"] = sql("v_attempts answered matched v_matched", f"""select message_id, count(*) filter (accepted) as relays_accepted,
    count(acked_at) as n_answered, count(*) as n_targets, case when bool_or(accepted) then 'Sent'
      when coalesce(max(sent_at) filter (acked_at is null), 0) + 30 > {MID_SHIPPING} then 'Sending' else 'Failed' end as status
    from v_matched group by message_id""")
ORACLES["t5_first_answer"] = sql(EVENTS + " v_copies", """, heard as (
      select pubkey as q, id, (event_id * 37 + relay * 911) % 12000 as t, relay, user_id,
        least(case when user_id % 9 <> relay then (user_id * 53 + relay * 2000) % 11000 else 8000 end, 8000) as fin from v_copies),
    sources as (select distinct q, relay, fin from heard), ok as (select * from heard where t <= fin),
    cut as (select q, min(fin) as c from sources join (select q, min(t) as f from ok group by q) using (q) where fin >= f group by q)
    select ok.q as query_id, id, min(t) as arrival, min(c) as cut_off from ok join cut on cut.q = ok.q where t <= c group by ok.q, id""")
ORACLES["t6_auth_outcomes"] = """with f as (select user_id % 20 as relay, event_id as seq, event_id % 4 = 0 as closed, 'k' || event_id % 500 as key,
      event_id % 4 <> 0 and event_id % 5 = 0 as flag, event_id % 3 = 0 as ask, event_id % 3 <> 0 and event_id % 7 = 0 as dup, event_id % 50 = 7 as auth from events),
    a as (select f.*, ask and not flag and seq > (select min(seq) from f g where g.relay = f.relay and g.auth) as asks from f where not auth),
    r as (select *, asks and row_number() over (partition by relay, closed, key, coalesce(asks, false) order by seq) = 1 as retried from a),
    o as (select relay, case when retried then 'retried' when closed then 'error' when flag or dup then 'accepted' else 'refused' end as outcome from r)
    select relay, count(*) filter (outcome = 'accepted') as n_accepted, count(*) filter (outcome = 'refused') as n_refused,
      count(*) filter (outcome = 'retried') as n_retried, count(*) filter (outcome = 'error') as n_error, count(*) as n_answers,
      round(count(*) filter (outcome = 'retried') / count(*), 6) as retry_rate from o group by relay"""
ORACLES["b1_verify_blobs"] = sql("v_blobs", "select url, case when (doc_id + server) % 3 = 0 then 'tampered' else 'ok' end as verdict from v_blobs")
ORACLES["b2_decrypt_blobs"] = """select doc_id, case doc_id % 10 when 0 then 'failed authentication' when 1 then 'bad key length'
      when 2 then 'nonce not supported' when 3 then 'bad nonce length' else 'ok' end as outcome,
    case when doc_id % 10 > 3 then sha256(text) end as plain_sha256 from documents"""
