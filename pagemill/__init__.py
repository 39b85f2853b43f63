"""Page crawling and extraction over corpora of web pages, on Spark."""
