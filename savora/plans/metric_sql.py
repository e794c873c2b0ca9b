"""SQL text of the ranking metrics, shared by several twins."""

from __future__ import annotations

from collections.abc import Sequence


def per_user_sql(hits: str, liked: str, ks: Sequence[int]) -> str:
    """`hits`(user_id, item, pos) and `liked`(user_id, item) are relation names."""
    return f"""
 SELECT c.user_id, c.m, kk.k,
   coalesce(sum(CASE WHEN h.pos <= kk.k THEN 1 ELSE 0 END), 0) / c.m AS recall,
   coalesce(sum(CASE WHEN h.pos <= kk.k THEN CAST(h.hit_no AS DOUBLE) / h.pos ELSE 0 END), 0) / c.m AS map,
   coalesce(sum(CASE WHEN h.pos <= kk.k THEN 1 / log2(h.pos + 1) ELSE 0 END), 0)
     / list_sum([1 / log2(i + 1) for i in range(1, least(c.m, kk.k) + 1)]) AS ndcg
 FROM (SELECT user_id, count(*) AS m FROM {liked} GROUP BY 1) c
 CROSS JOIN (SELECT unnest([{', '.join(map(str, ks))}]) AS k) kk
 LEFT JOIN (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS hit_no FROM {hits}) h
   ON h.user_id = c.user_id
 GROUP BY c.user_id, c.m, kk.k"""


def roll_up_sql(per_user: str, types: str) -> str:
    return f"""
 SELECT coalesce(user_type, 'all') AS user_type, k, round(avg(map), 6) AS map, round(avg(ndcg), 6) AS ndcg,
        round(avg(recall), 6) AS recall, count(*) AS "count"
 FROM {per_user} JOIN {types} USING (user_id) GROUP BY GROUPING SETS ((user_type, k), (k))"""


TYPES_SQL = """SELECT DISTINCT reviewer_id AS user_id,
 CASE WHEN reviewer_id IN (SELECT reviewer_id FROM train) THEN 'warm' ELSE 'cold' END AS user_type FROM val"""
LIKED_SQL = "SELECT reviewer_id AS user_id, diner_idx AS item FROM val"
