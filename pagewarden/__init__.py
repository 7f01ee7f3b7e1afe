"""Website privacy audits over crawled pages, as Spark jobs."""
