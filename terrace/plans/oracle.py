"""The registered queries in plain SQL, written independently of the library."""

_ACCOUNTS = """
    SELECT c_custkey AS account_id, c_nationkey AS nation_id, c_mktsegment AS segment,
           CAST(c_acctbal AS DECIMAL(18,2)) AS balance
    FROM customer"""

_NAMED_ACCOUNTS = """
    SELECT c_custkey AS account_id, c_name AS account_name, c_nationkey AS nation_id, c_mktsegment AS segment,
           CAST(c_acctbal AS DECIMAL(18,2)) AS balance
    FROM customer"""

_LINES = """
    SELECT l_orderkey AS ticket_id, l_linenumber AS line_no, l_returnflag AS flag,
           CAST(l_quantity AS DECIMAL(18,2)) AS units, CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price,
           CAST(l_discount AS DECIMAL(4,2)) AS rebate,
           CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net
    FROM lineitem"""

_GAPS = f"""
    SELECT o_orderkey AS ticket_id, o_custkey AS account_id, CAST(o_totalprice AS DECIMAL(18,2)) AS billed,
           coalesce(lines, 0) AS lines, CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(lines_net, 0) AS gap,
           CASE WHEN lines IS NULL THEN 'empty' WHEN CAST(o_totalprice AS DECIMAL(18,2)) < lines_net THEN 'under' ELSE 'over' END AS kind
    FROM orders LEFT JOIN (SELECT ticket_id, count(*) AS lines, sum(net) AS lines_net FROM ({_LINES}) GROUP BY ticket_id)
      ON o_orderkey = ticket_id"""

_ACCOUNT_GAPS = f"""
    SELECT account_id, c_mktsegment AS segment, count(ticket_id) AS tickets, sum(gap) AS total_gap, max(gap) AS widest,
           CASE WHEN sum(gap) / 1000 >= 1000 THEN 'GOLD' WHEN sum(gap) / 1000 >= 500 THEN 'SILVER' ELSE 'BRONZE' END AS grade
    FROM customer JOIN ({_GAPS}) ON c_custkey = account_id GROUP BY account_id, c_mktsegment"""

_PERTURBED = """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderkey % 100 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 60 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate,
           CASE WHEN o_orderkey % 70 = 9 THEN NULL ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 50 <> 7
    UNION ALL
    SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 40 = 1"""

_DIFF = f"""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
                WHEN a.o_custkey IS DISTINCT FROM b.o_custkey
                  OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
                  OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
                  OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
                  OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'modified'
                ELSE 'unchanged' END AS status,
           CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
             CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
             CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
             CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END,
             CASE WHEN a.o_orderdate IS DISTINCT FROM b.o_orderdate THEN 'o_orderdate' END,
             CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END)
           END AS changed_columns
    FROM orders a FULL JOIN ({_PERTURBED}) b ON a.o_orderkey = b.o_orderkey"""

_HEADERS = """
    SELECT CAST(event_id AS VARCHAR) AS archive_id, {asset} AS asset_name, 'table' AS asset_type,
           'dev' AS environment, ts AS archived_at,
           'team' || CAST(user_id % 3 AS VARCHAR) AS performed_by,
           strftime(ts, '%Y%m%d') AS git_sha, event_type AS git_branch,
           nullif(CAST(floor(value) AS BIGINT), 0) AS row_count
    FROM events"""
_USER_HEADERS = _HEADERS.format(asset="'user_' || CAST(user_id AS VARCHAR)")
_TABLE_HEADERS = _HEADERS.format(asset="'tbl_' || CAST(user_id % 7 AS VARCHAR)")

_ORDER_CHECKS = """
    SELECT 'tickets_ticket_id_not_null' AS name, 'not_null' AS type, 'cell' AS scope,
           'error' AS severity, 'completeness' AS dimension,
           (SELECT count(*) FROM orders WHERE o_orderkey IS NULL) AS failures
    UNION ALL SELECT 'tickets_ticket_id_unique', 'unique', 'column', 'error', 'uniqueness',
           (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL
                                  GROUP BY o_orderkey HAVING count(*) > 1))
    UNION ALL SELECT 'tickets_account_id_not_null', 'not_null', 'cell', 'error', 'completeness',
           (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
    UNION ALL SELECT 'tickets_state_accepted_values', 'accepted_values', 'cell', 'error', 'validity',
           (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
    UNION ALL SELECT 'total_range', 'range', 'cell', 'error', 'accuracy',
           (SELECT count(*) FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) < 2000
               OR CAST(o_totalprice AS DECIMAL(18,2)) > 499000)
    UNION ALL SELECT 'unbounded', 'range', 'cell', 'warn', 'accuracy', 0
    UNION ALL SELECT 'fresh_7_days', 'recency', 'column', 'warn', 'accuracy',
           (SELECT CASE WHEN max(CAST(o_orderdate AS DATE)) < TIMESTAMP '2001-08-05' - INTERVAL 7 DAY
                   THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'fresh_24_hours', 'recency', 'column', 'warn', 'accuracy',
           (SELECT CASE WHEN max(CAST(o_orderdate AS DATE)) < TIMESTAMP '2001-08-05' - INTERVAL 24 HOUR
                   THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'has_rows', 'row_count', 'table', 'error', 'accuracy',
           (SELECT CASE WHEN count(*) < 1 THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'has_many_rows', 'row_count', 'table', 'warn', 'accuracy',
           (SELECT CASE WHEN count(*) < 1000000000 THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'priority_format', 'regex', 'cell', 'warn', 'accuracy',
           (SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))
    UNION ALL SELECT 'unique_customer', 'unique', 'column', 'warn', 'uniqueness',
           (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL
                                  GROUP BY o_custkey HAVING count(*) > 1))
    UNION ALL SELECT 'customer_exists', 'relationships', 'column', 'error', 'consistency',
           (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL
               AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))
    UNION ALL SELECT 'many_accounts', 'cardinality', 'column', 'error', 'accuracy',
           (SELECT CASE WHEN count(DISTINCT o_custkey) < 10 THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'few_priorities', 'cardinality', 'column', 'warn', 'accuracy',
           (SELECT CASE WHEN count(DISTINCT o_orderpriority) > 4 THEN 1 ELSE 0 END FROM orders)
    UNION ALL SELECT 'numbered_by_date', 'monotonic', 'column', 'warn', 'consistency',
           (SELECT count(*) FROM (SELECT CAST(o_orderdate AS DATE) < lag(CAST(o_orderdate AS DATE))
                                         OVER (ORDER BY o_orderkey, CAST(o_orderdate AS DATE)) AS fell FROM orders) WHERE fell)
    UNION ALL SELECT 'late_open_orders', 'custom_sql', 'table', 'warn', 'accuracy',
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) < 1996)"""

_REGIONS = """SELECT * FROM (VALUES ('AFRICA', 0), ('AMERICA', 1), ('ASIA', 2), ('EUROPE', 3), ('MIDDLE EAST', 4),
    ('ANTARCTICA', NULL)) AS t(domain, rest)"""
_PRIORITIES = """SELECT * FROM (VALUES ('urgent', '1-URGENT'), ('high', '2-HIGH'), ('medium', '3-MEDIUM'),
    ('unset', '4-NOT SPECIFIED'), ('low', '5-LOW')) AS t(domain, priority)"""

_STATUS = """CASE WHEN failures = 0 THEN 'PASS' WHEN severity = 'error' THEN 'FAIL' ELSE 'WARN' END"""

_CHECKED = f"SELECT name, type, scope, severity, dimension, CAST(failures AS BIGINT) AS failures, {_STATUS} AS status FROM ({_ORDER_CHECKS})"

_LINEITEM_CHECKS = f"""
    SELECT name, type, scope, severity, dimension, CAST(failures AS BIGINT) AS failures, {_STATUS} AS status
    FROM (
    SELECT 'quantity_range' AS name, 'range' AS type, 'cell' AS scope, 'warn' AS severity,
           'accuracy' AS dimension,
           (SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 49) AS failures
    UNION ALL SELECT 'discount_range', 'range', 'cell', 'warn', 'accuracy',
           (SELECT count(*) FROM lineitem WHERE l_discount > 0.09::DOUBLE)
    UNION ALL SELECT 'flags', 'accepted_values', 'cell', 'warn', 'validity',
           (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
    UNION ALL SELECT 'part_present', 'not_null', 'cell', 'warn', 'completeness',
           (SELECT count(*) FROM lineitem WHERE l_partkey IS NULL)
    UNION ALL SELECT 'status_shape', 'regex', 'cell', 'warn', 'accuracy',
           (SELECT count(*) FROM lineitem WHERE NOT regexp_matches(l_linestatus, 'F'))
    UNION ALL SELECT 'order_unique', 'unique', 'column', 'warn', 'uniqueness',
           (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'order_exists', 'relationships', 'column', 'warn', 'consistency',
           (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))"""

_LINEAGE_FLAT = """
    SELECT o_orderkey AS ticket_id, '4' AS schema_version, 'tickets' AS model, 'orders' AS sources,
           'abc1234' AS git_commit, 'default.tickets' AS contract_id, 'v1' AS version,
           '{mode}' AS lineage_mode, CAST(3 AS BIGINT) AS derived_columns, 'CAST' AS first_op,
           'cast(o_totalprice as decimal(18,2))' AS first_expression, {value} AS first_input,
           'EXPRESSION' AS last_op
    FROM orders"""

# (target_model, target_column, op, source_model, source_column, whether recorded when the model is built)
_EDGES = """
    SELECT * FROM (VALUES
      ('accounts', 'account_id', 'PASSTHROUGH', 'customer', 'c_custkey', true),
      ('accounts', 'nation_id', 'PASSTHROUGH', 'customer', 'c_nationkey', true),
      ('accounts', 'segment', 'PASSTHROUGH', 'customer', 'c_mktsegment', true),
      ('accounts', 'balance', 'CAST', 'customer', 'c_acctbal', true),
      ('tickets', 'ticket_id', 'PASSTHROUGH', 'orders', 'o_orderkey', true),
      ('tickets', 'account_id', 'PASSTHROUGH', 'orders', 'o_custkey', true),
      ('tickets', 'state', 'PASSTHROUGH', 'orders', 'o_orderstatus', true),
      ('tickets', 'priority', 'PASSTHROUGH', 'orders', 'o_orderpriority', true),
      ('tickets', 'billed', 'CAST', 'orders', 'o_totalprice', true),
      ('tickets', 'placed_on', 'CAST', 'orders', 'o_orderdate', true),
      ('tickets', 'urgency', 'EXPRESSION', 'orders', 'o_orderpriority', true),
      ('ticket_lines', 'ticket_id', 'PASSTHROUGH', 'lineitem', 'l_orderkey', true),
      ('ticket_lines', 'line_no', 'PASSTHROUGH', 'lineitem', 'l_linenumber', true),
      ('ticket_lines', 'flag', 'PASSTHROUGH', 'lineitem', 'l_returnflag', true),
      ('ticket_lines', 'units', 'CAST', 'lineitem', 'l_quantity', true),
      ('ticket_lines', 'list_price', 'CAST', 'lineitem', 'l_extendedprice', true),
      ('ticket_lines', 'rebate', 'CAST', 'lineitem', 'l_discount', true),
      ('ticket_lines', 'net', 'EXPRESSION', 'ticket_lines', 'list_price', true),
      ('ticket_lines', 'net', 'EXPRESSION', 'ticket_lines', 'rebate', true),
      ('line_totals', 'ticket_id', 'PASSTHROUGH', 'ticket_lines', 'ticket_id', true),
      ('line_totals', 'largest', 'AGGREGATION', 'ticket_lines', 'units', true),
      ('line_totals', 'lines_net', 'AGGREGATION', 'ticket_lines', 'net', true),
      ('ticket_gaps', 'ticket_id', 'PASSTHROUGH', 'tickets', 'ticket_id', true),
      ('ticket_gaps', 'ticket_id', 'PASSTHROUGH', 'line_totals', 'ticket_id', false),
      ('ticket_gaps', 'account_id', 'PASSTHROUGH', 'tickets', 'account_id', true),
      ('ticket_gaps', 'billed', 'PASSTHROUGH', 'tickets', 'billed', true),
      ('ticket_gaps', 'lines', 'EXPRESSION', 'line_totals', 'lines', true),
      ('ticket_gaps', 'gap', 'EXPRESSION', 'tickets', 'billed', true),
      ('ticket_gaps', 'gap', 'EXPRESSION', 'line_totals', 'lines_net', true),
      ('ticket_gaps', 'kind', 'CASE', 'line_totals', 'lines', true),
      ('ticket_gaps', 'kind', 'CASE', 'tickets', 'billed', true),
      ('ticket_gaps', 'kind', 'CASE', 'line_totals', 'lines_net', true),
      ('solvent', 'account_id', 'PASSTHROUGH', 'accounts', 'account_id', true),
      ('solvent', 'nation_id', 'PASSTHROUGH', 'accounts', 'nation_id', true),
      ('solvent', 'segment', 'PASSTHROUGH', 'accounts', 'segment', true),
      ('solvent', 'balance', 'PASSTHROUGH', 'accounts', 'balance', true),
      ('account_gaps', 'account_id', 'PASSTHROUGH', 'solvent', 'account_id', true),
      ('account_gaps', 'account_id', 'PASSTHROUGH', 'ticket_gaps', 'account_id', false),
      ('account_gaps', 'segment', 'PASSTHROUGH', 'solvent', 'segment', true),
      ('account_gaps', 'tickets', 'AGGREGATION', 'ticket_gaps', 'ticket_id', true),
      ('account_gaps', 'total_gap', 'AGGREGATION', 'ticket_gaps', 'gap', true),
      ('account_gaps', 'widest', 'AGGREGATION', 'ticket_gaps', 'gap', true),
      ('account_gaps', 'grade', 'SQL_UDF', 'account_gaps', 'total_gap', true)
    ) AS e(target_model, target_column, op, source_model, source_column, recorded)"""

_MODEL_ROWS = """
    SELECT 'accounts' AS model, (SELECT count(*) FROM customer) AS model_rows
    UNION ALL SELECT 'tickets', (SELECT count(*) FROM orders)
    UNION ALL SELECT 'ticket_lines', (SELECT count(*) FROM lineitem)
    UNION ALL SELECT 'line_totals', (SELECT count(DISTINCT l_orderkey) FROM lineitem)
    UNION ALL SELECT 'ticket_gaps', (SELECT count(*) FROM orders)
    UNION ALL SELECT 'solvent', (SELECT count(*) FROM customer)
    UNION ALL SELECT 'account_gaps', (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey)"""

_EVENT_TOTALS = "count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value"

_EXISTENCE = """SELECT c_custkey AS customer_id FROM customer WHERE {word} EXISTS (
    SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"""

_LEFT_JOIN = """SELECT c_custkey AS customer_id, coalesce(o_orderkey, -1) AS order_id
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40 * c_acctbal"""

ORACLE = {
    "stage_customers": f"SELECT account_id, account_name, nation_id, segment, CAST(balance AS DOUBLE) AS balance FROM ({_NAMED_ACCOUNTS})",
    "stage_orders": """SELECT o_orderkey AS ticket_id, o_custkey AS account_id, o_orderstatus AS state,
        o_orderpriority AS priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS billed,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS placed_on,
        CAST(left(o_orderpriority, 1) AS INTEGER) AS urgency FROM orders""",
    "stage_lineitem": f"""SELECT ticket_id, line_no, flag, CAST(units AS DOUBLE) AS units, CAST(list_price AS DOUBLE) AS list_price,
        CAST(rebate AS DOUBLE) AS rebate, CAST(net AS DOUBLE) AS net FROM ({_LINES})""",
    "contract_transform": """SELECT n_nationkey, lower(n_name) AS n_name, count(*) AS suppliers
        FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""",
    "quarantine_customers": f"""SELECT account_id, account_name, nation_id, segment, CAST(balance AS DOUBLE) AS balance,
        'solvent' AS _quarantine_source, 'abc1234' AS _quarantine_git_commit,
        '2024-01-31 00:00:00' AS _quarantine_detected_at FROM ({_NAMED_ACCOUNTS}) WHERE balance < 0""",
    "clean_customers": f"""SELECT account_id, account_name, nation_id, segment, CAST(balance AS DOUBLE) AS balance
        FROM ({_NAMED_ACCOUNTS}) WHERE balance >= 0""",
    "typed_reference": """SELECT o_orderpriority AS priority, count(*) AS orders, coalesce(max(days), -1) AS days,
        CAST(coalesce(sum(fee), 0) AS DOUBLE) AS fees
        FROM orders LEFT JOIN (VALUES ('1-URGENT', 1, 25.50::DECIMAL(6,2)), ('2-HIGH', 3, 12.00), ('3-MEDIUM', 7, NULL),
            ('5-LOW', 30, 0.75)) AS p(priority, days, fee) ON o_orderpriority = p.priority GROUP BY o_orderpriority""",
    "quarantine_null_rule": """SELECT side, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
        SELECT n_chars, CASE WHEN coalesce(CAST(nullif(n_chars, 0) AS DOUBLE) / nullif(length(source) - 4, 0), 0) > 1000
            THEN 'quarantined' ELSE 'clean' END AS side FROM documents) GROUP BY side""",
    "enrich_orders": f"""SELECT ticket_id, account_id, CAST(billed AS DOUBLE) AS billed, lines,
        CAST(gap AS DOUBLE) AS gap, kind FROM ({_GAPS})""",
    "nway_join": """SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, r_name AS region
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "left_join": _LEFT_JOIN,
    "salted_left_join": _LEFT_JOIN,
    "right_join": _LEFT_JOIN,
    "full_join": """SELECT coalesce(c_name, 'none') AS customer, coalesce(s_name, 'none') AS supplier
        FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey % 5 = s_nationkey % 5""",
    "semi_join": _EXISTENCE.format(word=""),
    "anti_join": _EXISTENCE.format(word="NOT"),
    "salted_join": """SELECT o_orderpriority AS priority, count(*) AS lines,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
    "customer_summary": f"""SELECT account_id, segment, tickets, CAST(total_gap AS DOUBLE) AS total_gap,
        CAST(widest AS DOUBLE) AS widest, grade FROM ({_ACCOUNT_GAPS})""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, count(*) AS lines,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, avg(l_quantity) AS avg_qty,
        min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
        CASE WHEN count(*) > 1000 THEN 'large' ELSE 'small' END AS volume,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "orders_by_year": """SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus,
        count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
        count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2""",
    "global_totals": """SELECT count(*) AS lines, max(l_shipdate) AS last_ship,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem""",
    "pandas_score": """SELECT p_partkey, (CAST(p_size AS DOUBLE) + nullif(p_retailprice, 900)) / 2 AS score FROM part""",
    "python_clean_email": """SELECT c_custkey, lower(c_name || '@' || c_mktsegment || '.com') AS email FROM customer""",
    "clean_document_text": """SELECT doc_id, md5(lower(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13),
        chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(8195), chr(12288))))) AS clean_md5 FROM documents""",
    "customer_content_hash": """SELECT c_custkey, sha256(CAST(to_json({c_custkey: c_custkey, c_name: c_name,
        c_mktsegment: c_mktsegment}) AS VARCHAR)) AS content_hash FROM customer""",
    "lineage_flat": _LINEAGE_FLAT.format(mode="full", value="CAST(o_totalprice AS VARCHAR)"),
    "lineage_lightweight": _LINEAGE_FLAT.format(mode="lightweight", value="'o_totalprice'"),
    "lineage_operations": f"""SELECT e.model, e.name, e.op, r.model_rows AS rows
        FROM (SELECT DISTINCT target_model AS model, target_column AS name, op FROM ({_EDGES})
              UNION ALL SELECT 'line_totals', 'lines', 'AGGREGATION') e
        JOIN ({_MODEL_ROWS}) r ON r.model = e.model""",
    "origin_stamp": """SELECT c_custkey AS account_id, 'external_table' AS origin_type, 'customer' AS origin_path,
        TIMESTAMP '2001-08-05 00:00:00' AS loaded_at FROM customer""",
    "challenge_summary": f"""SELECT 'account_gaps' AS challenged_model, 'total_gap' AS challenged_column,
        'account_gaps' AS _lineage_model, 'solvent, ticket_gaps' AS _lineage_sources,
        'abc1234' AS _lineage_git_commit, '2024-01-31 00:00:00' AS _lineage_deployed_at,
        'serverless' AS _lineage_compute_type, 'default.account_gaps' AS _lineage_contract_id,
        'v1' AS _lineage_version, '4' AS _lineage_schema_version,
        CAST(total_gap AS DOUBLE) AS challenged_value FROM ({_ACCOUNT_GAPS}) WHERE grade = 'GOLD'""",
    "lineage_upgrade": """SELECT o_orderkey, '4' AS schema_version, 'old_orders' AS model,
        CASE WHEN o_orderstatus = 'O' THEN 'orders' ELSE '' END AS sources, 'unknown' AS git_commit,
        'serverless' AS compute_type, 'v1' AS version, 'full' AS lineage_mode, 'CAST' AS first_op,
        true AS no_origin FROM orders""",
    "lineage_edges": f"SELECT target_model, target_column, op, source_model, source_column FROM ({_EDGES})",
    "column_trace": f"""
        SELECT t.*, r.model_rows FROM (VALUES
          ('account_gaps', 'grade', 'SQL_UDF', 'account_gaps', 'total_gap', 1),
          ('account_gaps', 'total_gap', 'AGGREGATION', 'ticket_gaps', 'gap', 2),
          ('ticket_gaps', 'gap', 'EXPRESSION', 'tickets', 'billed', 3),
          ('ticket_gaps', 'gap', 'EXPRESSION', 'line_totals', 'lines_net', 3),
          ('tickets', 'billed', 'CAST', 'orders', 'o_totalprice', 4),
          ('line_totals', 'lines_net', 'AGGREGATION', 'ticket_lines', 'net', 4),
          ('ticket_lines', 'net', 'EXPRESSION', 'ticket_lines', 'list_price', 5),
          ('ticket_lines', 'net', 'EXPRESSION', 'ticket_lines', 'rebate', 5),
          ('ticket_lines', 'list_price', 'CAST', 'lineitem', 'l_extendedprice', 6),
          ('ticket_lines', 'rebate', 'CAST', 'lineitem', 'l_discount', 6)
        ) AS t(target_model, target_column, op, source_model, source_column, depth)
        JOIN ({_MODEL_ROWS}) r ON r.model = t.target_model""",
    "provenance_registry": f"""SELECT DISTINCT target_model, target_column, source_model, source_column, r.model_rows,
        'abc1234' AS git_commit, '2024-01-31 00:00:00' AS deployed_at
        FROM ({_EDGES}) JOIN ({_MODEL_ROWS}) r ON r.model = target_model WHERE recorded""",
    "registry_two_runs": f"""
        WITH runs AS (
          SELECT *, 'first' AS _run, 'abc1234' AS git_commit FROM ({_EDGES}) WHERE recorded AND target_model = 'ticket_gaps'
          UNION ALL
          SELECT *, 'second', 'def5678' FROM ({_EDGES}) WHERE recorded AND target_model = 'ticket_gaps')
        SELECT _run, target_column, op, source_model,
               CASE WHEN _run = 'second' AND target_column = 'gap' AND source_column = 'lines_net' THEN 'largest'
                    ELSE source_column END AS source_column,
               (SELECT count(*) FROM orders) AS model_rows, git_commit FROM runs""",
    "check_results": _CHECKED,
    "check_dimensions": f"SELECT dimension, status, count(*) AS checks FROM ({_CHECKED}) GROUP BY dimension, status",
    "lineitem_checks": _LINEITEM_CHECKS,
    "reconcile_counts": """
        WITH counts AS (SELECT (SELECT count(*) FROM customer) AS staged,
                               (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS clean),
        pairs AS (
          SELECT 'lost' AS check_name, 'accounts' AS source_table,
                 'solvent' AS target_table, staged AS source_count, clean AS target_count,
                 staged - clean AS gap FROM counts
          UNION ALL SELECT 'same', 'accounts', 'accounts', staged, staged, 0 FROM counts
          UNION ALL SELECT 'gained', 'solvent', 'accounts', clean, staged, clean - staged FROM counts
          UNION ALL SELECT 'gained_abs', 'solvent', 'accounts', clean, staged, staged - clean FROM counts)
        SELECT check_name, source_table, target_table, source_count, target_count,
               source_count - target_count AS delta,
               CASE WHEN source_count = target_count THEN 'PASS' WHEN gap <= 5 THEN 'WARN' ELSE 'FAIL' END AS status,
               TIMESTAMP '2001-08-05 00:00:00' AS checked_at FROM pairs""",
    "reconcile_totals": f"""
        WITH a AS (SELECT sum(total_gap) AS v, count(*) AS n FROM ({_ACCOUNT_GAPS})),
             g AS (SELECT sum(gap) AS v FROM ({_GAPS})), o AS (SELECT count(*) AS n FROM orders)
        SELECT 'gap_match' AS name, CAST(a.v AS DOUBLE) AS child_value, CAST(g.v AS DOUBLE) AS parent_value,
               CAST(abs(a.v - g.v) AS DOUBLE) AS difference,
               CASE WHEN abs(a.v - g.v) <= 0.0001 THEN 'PASS' ELSE 'FAIL' END AS status FROM a, g
        UNION ALL
        SELECT 'row_match', CAST(a.n AS DOUBLE), CAST(o.n AS DOUBLE), CAST(abs(a.n - o.n) AS DOUBLE),
               CASE WHEN abs(a.n - o.n) <= 1 THEN 'PASS' ELSE 'FAIL' END FROM a, o""",
    "reconcile_log": """
        WITH runs AS (SELECT * FROM (VALUES ('monday', 'O'), ('tuesday', 'O'), ('wednesday', 'P')) AS t(_run, status)),
        counts AS (
          SELECT _run, status, (SELECT count(*) FROM orders) AS every, (SELECT count(*) FROM orders WHERE o_orderstatus = status) AS part,
                 (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = status) AS lines
          FROM runs),
        rows AS (
          SELECT _run, 'orders_' || status AS check_name, 'orders' AS source_table, every AS a, part AS b, every - part AS gap FROM counts
          UNION ALL SELECT _run, 'lines_' || status, 'lines', lines, part, abs(lines - part) FROM counts)
        SELECT check_name, source_table, 'part' AS target_table, a AS source_count, b AS target_count, a - b AS delta,
               CASE WHEN a = b THEN 'PASS' WHEN gap <= 5 THEN 'WARN' ELSE 'FAIL' END AS status,
               TIMESTAMP '2001-08-05 00:00:00' AS checked_at, _run FROM rows""",
    "evolve_stored": """
        WITH lost AS (
          SELECT count(*) FILTER (WHERE TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL AND o_totalprice IS NOT NULL) AS lost_totals,
                 count(*) FILTER (WHERE TRY_CAST(o_orderpriority AS INTEGER) IS NULL AND o_orderpriority IS NOT NULL) AS lost_priorities
          FROM orders),
        sides AS (
          SELECT 'current' AS side, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
                 count(*) FILTER (WHERE o_totalprice > 300000) AS gold,
                 'order_id,customer_id,o_orderstatus,o_totalprice,o_orderdate,size_class,note' AS columns FROM orders
          UNION ALL
          SELECT 'previous', count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0,
                 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' FROM orders)
        SELECT * FROM sides, lost""",
    "view_models": """SELECT c_nationkey AS nation_id, count(*) AS customers, count(TRY_CAST(c_acctbal AS DECIMAL(5,2))) AS small,
        CAST(sum(TRY_CAST(c_acctbal AS DECIMAL(5,2))) AS DOUBLE) AS balance FROM customer GROUP BY c_nationkey""",
    "restore_into_table": """
        SELECT side, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, max(ts) AS last_event,
               (SELECT count(*) FROM events) AS restored_rows
        FROM events, (VALUES ('restored'), ('previous')) AS s(side)
        WHERE side = 'restored' OR event_type <> 'click' GROUP BY side, event_type""",
    "archive_of_one": """
        SELECT 'orders' AS asset_name, TIMESTAMP '2024-02-02 00:00:00' AS archived_at, 'ann' AS performed_by,
               CAST(count(*) AS DOUBLE) AS row_count FROM orders
        UNION ALL SELECT 'orders', TIMESTAMP '2024-02-04 00:00:00', 'ann', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F'""",
    "invalid_orders": """SELECT * FROM (SELECT o_orderkey, concat_ws('; ',
            CASE WHEN TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL THEN 'o_totalprice: not a decimal(7,2)' END,
            CASE WHEN o_orderpriority = '5-LOW' THEN 'o_orderpriority: required value is missing' END) AS errors
        FROM orders) WHERE errors <> ''""",
    "domain_split": """SELECT r_name AS domain, count(*) AS customers,
        CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "domain_summary": """SELECT r_name AS domain, n_name AS nation, count(*) AS orders,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, 'nation_revenue_' || r_name AS instance
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
    "domain_sources": f"""SELECT d.domain, o.o_orderkey AS order_id, d.top
        FROM orders o JOIN (SELECT o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority) m
          ON o.o_orderpriority = m.o_orderpriority AND o.o_totalprice > m.top * 0.99::DOUBLE
        JOIN (SELECT p.domain, p.priority, max(o_totalprice) AS top
              FROM orders JOIN ({_PRIORITIES}) p ON o_orderpriority = p.priority GROUP BY 1, 2) d
          ON o.o_orderpriority = d.priority""",
    "domain_left_join": f"""SELECT r.domain, n.n_name AS nation, count(s_suppkey) AS suppliers,
        CAST(coalesce(sum(CAST(s_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS balance,
        'nation_suppliers_' || r.domain AS instance
        FROM ({_REGIONS}) r CROSS JOIN nation n
        LEFT JOIN supplier ON s_nationkey = n.n_nationkey AND s_nationkey % 5 = r.rest GROUP BY r.domain, n.n_name""",
    "domain_full_join": f"""SELECT r.domain, coalesce(c_name, 'none') AS customer, coalesce(s_name, 'none') AS supplier
        FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey % 5 = s_suppkey % 5
        JOIN ({_REGIONS}) r ON r.rest = coalesce(c_nationkey % 5, s_suppkey % 5)""",
    "domain_anti_join": f"""SELECT p.domain, c_custkey AS customer_id FROM customer CROSS JOIN ({_PRIORITIES}) p
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p.priority)""",
    "domain_totals": f"""SELECT r.domain, count(c_custkey) AS rows, count(o_orderkey) AS orders,
        CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue,
        'region_totals_' || r.domain AS instance
        FROM ({_REGIONS}) r LEFT JOIN customer ON c_nationkey % 5 = r.rest LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY r.domain""",
    "domain_replicated": """SELECT d.domain, r_regionkey, r_name
        FROM region, (VALUES ('eu'), ('us'), ('apac')) AS d(domain)""",
    "incremental_sync": f"""SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS _batch,
        {_EVENT_TOTALS}, CAST(0 AS BIGINT) AS third_run FROM events GROUP BY 1, 2""",
    "ingest_manifest": """SELECT 'raw_events' AS model_name, 'eu' AS domain, 'csv' AS file_format,
        'SUCCESS' AS status, count(*) AS row_count, CAST(0 AS BIGINT) AS repeated_files,
        CAST(0 AS BIGINT) AS second_run_files FROM events""",
    "ingest_rows": """SELECT event_id, ts, user_id, event_type, value, props, '3' AS schema_version,
        'raw_events' AS model, 'volume' AS source_type FROM events""",
    "stream_ingest": f"""SELECT event_type, {_EVENT_TOTALS} FROM events GROUP BY event_type
        UNION ALL SELECT 'manifest', count(*), 0 FROM events""",
    "ingest_batch_then_stream": f"""SELECT event_type, CASE WHEN event_id % 5 IN (0, 4) THEN 'run' ELSE 'stream' END AS loader,
        {_EVENT_TOTALS} FROM events GROUP BY 1, 2""",
    "ingest_rejects": """
        WITH found AS (
          SELECT o_orderkey AS key, TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL AS large, o_orderpriority = '5-LOW' AS missing FROM orders),
        named AS (
          SELECT key, 'good' AS problem FROM found WHERE NOT large AND NOT missing
          UNION ALL SELECT key, 'o_totalprice: not a decimal(7,2)' FROM found WHERE large
          UNION ALL SELECT key, 'o_orderpriority: required value is missing' FROM found WHERE missing)
        SELECT problem, count(*) AS rows, CAST(sum(key) AS BIGINT) AS keys, form
        FROM named, (VALUES ('batch'), ('stream')) AS f(form) GROUP BY problem, form""",
    "ingest_checksums": """
        WITH files AS (
          SELECT 'c_custkey,c_name' || chr(10) || string_agg(c_custkey || ',' || c_name || chr(10), '' ORDER BY c_custkey) AS content,
                 count(*) AS row_count
          FROM customer GROUP BY c_nationkey % 5)
        SELECT sha256(array_to_string([sha256(substr(content, 1 + 65536 * i, 65536))
                                       FOR i IN range((length(content) + 65535) // 65536)], '')) AS checksum,
               row_count, CAST(length(content) AS BIGINT) AS file_size_bytes, CAST(0 AS BIGINT) AS rejected_count
        FROM files""",
    "seed_scan": """SELECT s_suppkey, s_name, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS s_acctbal FROM supplier""",
    "landing_formats": """SELECT quality, toxic, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids, file_format
        FROM labels, (VALUES ('csv'), ('json'), ('parquet')) AS f(file_format) GROUP BY quality, toxic, file_format""",
    "sql_source": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 250000 GROUP BY o_orderstatus",
    "prior_version": """SELECT 'previous' AS side, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer
        UNION ALL SELECT 'current', count(*), CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer WHERE c_acctbal >= 0""",
    "stored_model": f"""
        SELECT 'model' AS side, count(*) AS customers, CAST(sum(balance) AS DOUBLE) AS balance
        FROM ({_ACCOUNTS}) WHERE nation_id < 20
        UNION ALL SELECT 'previous', count(*), CAST(sum(balance) AS DOUBLE) FROM ({_ACCOUNTS})
        UNION ALL SELECT 'quarantine', count(*), CAST(sum(balance) AS DOUBLE)
        FROM ({_ACCOUNTS}) WHERE nation_id < 20 AND balance < 0""",
    "migrated_table": """SELECT o_orderstatus, '4' AS schema_version, 'serverless' AS compute_type,
        count(*) AS orders, CAST(1 AS BIGINT) AS rewrites FROM orders GROUP BY o_orderstatus""",
    "managed_table": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "append_with_lineage": """SELECT '/landing/' || CAST(quality AS VARCHAR) AS source_path, 'api' AS source_type,
        count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM labels WHERE quality IN (0, 1) GROUP BY quality""",
    "archive_restore": "SELECT * FROM events",
    "archive_listing": """
        SELECT 'nation' AS asset_name, 'table' AS asset_type, 'shop' AS project, 'dev' AS environment,
               TIMESTAMP '2024-02-01 00:00:00' AS archived_at, 'ann' AS performed_by, 'sha1' AS git_sha,
               'main' AS git_branch, 'job' AS dab_name, CAST((SELECT count(*) FROM nation) AS DOUBLE) AS row_count
        UNION ALL SELECT 'supplier', 'table', 'shop', 'dev', TIMESTAMP '2024-02-01 01:00:00', 'ann', 'sha1', 'main', 'job',
               (SELECT count(*) FROM supplier)
        UNION ALL SELECT 'events', 'table', 'shop', 'dev', TIMESTAMP '2024-02-01 02:00:00', 'ann', 'sha1', 'main', 'job',
               (SELECT count(*) FROM events)
        UNION ALL SELECT 'functions/loyalty_tier.sql', 'function', 'shop', 'dev', TIMESTAMP '2024-02-01 09:00:00', 'ann',
               'sha1', 'main', 'job', NULL""",
    "archive_diff": f"""
        WITH headers AS ({_USER_HEADERS}),
        a AS (SELECT *, coalesce(git_sha, git_branch) AS ref, row_number() OVER (
                PARTITION BY asset_name ORDER BY archived_at DESC, archive_id DESC) AS rn
              FROM headers WHERE git_sha = '20240110' OR git_branch = '20240110'),
        b AS (SELECT *, coalesce(git_sha, git_branch) AS ref, row_number() OVER (
                PARTITION BY asset_name ORDER BY archived_at DESC, archive_id DESC) AS rn
              FROM headers WHERE git_sha = 'purchase' OR git_branch = 'purchase')
        SELECT coalesce(a.asset_name, b.asset_name) AS asset_name,
               coalesce(a.asset_type, b.asset_type) AS asset_type,
               CASE WHEN a.asset_name IS NULL THEN 'ADDED' WHEN b.asset_name IS NULL THEN 'REMOVED'
                    ELSE 'CHANGED' END AS change_type,
               a.ref AS ref_a_value, b.ref AS ref_b_value,
               CAST(a.row_count AS DOUBLE) AS ref_a_row_count, CAST(b.row_count AS DOUBLE) AS ref_b_row_count,
               a.archived_at AS ref_a_timestamp, b.archived_at AS ref_b_timestamp
        FROM (SELECT * FROM a WHERE rn = 1) a FULL JOIN (SELECT * FROM b WHERE rn = 1) b
          ON a.asset_name = b.asset_name
        WHERE a.asset_name IS NULL OR b.asset_name IS NULL OR a.row_count <> b.row_count""",
    "latest_archives": f"""SELECT asset_name, archived_at, archive_id, git_branch, CAST(row_count AS DOUBLE) AS row_count FROM (
        SELECT *, row_number() OVER (PARTITION BY asset_name ORDER BY archived_at DESC, archive_id DESC) AS rn
        FROM ({_USER_HEADERS})) WHERE rn = 1""",
    "deploy_history": f"""
        SELECT deployment_id, git_sha, git_branch, environment, performed_by, deployed_at, asset_count,
               total_rows, assets
        FROM (SELECT *, row_number() OVER (ORDER BY deployed_at DESC, git_sha, git_branch, environment, performed_by) AS deployment_id
              FROM (SELECT git_sha, git_branch, environment, performed_by, min(archived_at) AS deployed_at,
                           count(*) AS asset_count, CAST(sum(row_count) AS BIGINT) AS total_rows,
                           string_agg(DISTINCT asset_name, ', ' ORDER BY asset_name) AS assets
                    FROM ({_TABLE_HEADERS}) GROUP BY git_sha, git_branch, environment, performed_by))
        WHERE deployment_id <= 25""",
    "snapshot_diff": _DIFF,
    "snapshot_diff_summary": f"SELECT status, count(*) AS keys FROM ({_DIFF}) GROUP BY status",
    "evolve_orders": """SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice, o_orderdate,
        CASE WHEN o_totalprice > 300000 THEN 'gold' ELSE 'it''s bronze' END AS size_class, 'none' AS note FROM orders""",
    "evolve_dry_run": """SELECT change, (SELECT count(*) FROM orders) AS rows FROM (VALUES
        ('add column ''size_class'' string'), ('add column ''note'' string'), ('remove column ''o_orderpriority'''),
        ('rename ''o_custkey'' to ''customer_id'''), ('retype ''o_totalprice'': double to decimal(18,2)'),
        ('rename ''o_orderkey'' to ''order_id'''), ('retype ''customer_id'': bigint to string')) AS t(change)""",
    "retype_losses": """
        SELECT 'o_totalprice' AS "column", count(*) AS unconvertible FROM orders WHERE TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL
        UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE TRY_CAST(o_custkey AS TINYINT) IS NULL
        UNION ALL SELECT 'o_orderpriority', count(*) FROM orders WHERE TRY_CAST(o_orderpriority AS INTEGER) IS NULL""",
}
ORACLE["salted_full_join"] = ORACLE["full_join"]
ORACLE["archive_diff_sql"] = ORACLE["archive_diff"]
ORACLE["deploy_history_sql"] = ORACLE["deploy_history"]
