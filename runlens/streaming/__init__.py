"""runlens.streaming"""
