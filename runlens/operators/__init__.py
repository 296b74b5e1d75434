"""runlens.operators"""
