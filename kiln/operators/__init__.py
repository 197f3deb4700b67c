"""DataFrame operators: ranking, sampling, features, metrics, training, graph, text, clustering."""
