"""Table contracts between stages."""

# The columns of each table, in their order.
RAW_ITEM = (
    "id string, name string, link_id string, parent_id string, subreddit string, author string, title string, "
    "selftext string, body string, permalink string, distinguished string, created_utc double, ups double, downs double"
)
MESSAGE = (
    "id string, link_id string, parent_id string, subreddit string, author string, body string, permalink string, "
    "created_utc double, ups double, downs double, sanitized_prefix string, cpu_filter_is_idea boolean, "
    "is_idea boolean, nlp_top_score float"
)
NLP_JOB = "file_path string, row_id string, text string"
NLP_RESULT = "file_path string, row_id string, nlp_label string, nlp_score float"
CLUSTER_ANALYSIS = (
    "cluster_summary string, is_viable_business boolean, viability_score int, is_saas boolean, "
    "is_solo_entrepreneur_possible boolean"
)
PLAN = (
    "title string, executive_summary string, problem string, solution string, "
    "market_analysis struct<target_market: string, market_size: string, trends: array<string>>, "
    "competition struct<competitors: array<string>, direct_competitors: array<string>, indirect_competitors: array<string>, "
    "competitive_advantages: array<string>>, "
    "marketing_strategy struct<value_proposition: string, pricing_strategy: string, distribution_channels: string, "
    "online_presence: string, content_strategy: string, seo_optimization: string, paid_advertising: string, "
    "public_relations: string, partnerships: array<string>, customer_acquisition: array<string>, retention: array<string>>, "
    "management_team struct<description: string, roles: array<struct<role: string, description: string>>>, "
    "financial_projections struct<potential_monthly_revenue: string, revenue_streams: array<string>, cost_structure: array<string>>, "
    "call_to_action string"
)
SCORE = "score double, reasoning string"
# The fields that are searched, and the boosts of the ones that count more.
SEARCHED = [
    "title", "executive_summary", "problem", "solution", "market_analysis", "competition", "marketing_strategy", "call_to_action",
    "cluster_summary", "texts_combined",
]
BOOSTS = {"title": 3.0, "executive_summary": 2.0}
# Columns that may hold the text, the id or the score, in order of preference.
TEXT_COLUMNS = ["body", "text", "selftext", "content", "message"]
ID_COLUMNS = ["id", "message_id", "comment_id", "post_id", "name"]
SCORE_COLUMNS = ["quality_score", "score", "nlp_top_score", "ups"]


def first_column(columns: list[str], wanted: list[str]) -> str:
    """The first wanted column that is there."""
    for name in wanted:
        if name in columns:
            return name
    raise ValueError(f"none of {wanted} in {columns}")
