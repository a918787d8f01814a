"""Whole jobs: convert pages, crawl a site, build a corpus."""
