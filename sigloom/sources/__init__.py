"""Tables, change streams, messages and sinks."""
