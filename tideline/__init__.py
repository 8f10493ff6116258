"""Timeline, place and text analytics as DataFrame-in / DataFrame-out Spark operators."""
