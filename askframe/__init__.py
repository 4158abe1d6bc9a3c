"""Retrieval-augmented multiple-choice question answering as Spark jobs.

Every operator takes DataFrames and returns a lazy DataFrame.  Sub-packages:

* ``sources``   typed readers and writers
* ``functions`` column expressions (text, vectors, letters, prompts)
* ``operators`` curation, retrieval, scoring, metrics, blending, logs
* ``plans``     whole flows composed from operators
* ``streaming`` Structured Streaming versions of the job-status operators
* ``catalog``   the operators run on the shared test tables, with oracle SQL
"""
