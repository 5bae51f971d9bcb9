"""Named queries over the operators. Importing this package registers all of them."""

from tierwise.plans import cost_queries, eval_queries, label_queries, publish_queries, seed_queries  # noqa: F401
